"""Repository URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import trimmed

# URL patterns and first path segments that never name an owner.
HOST = r"(?:https?://)?(?:www\.)?github\.com/"
GIST_PREFIX = r"(?i)^(?:https?://)?(?:www\.)?(?:gist\.github\.com|github\.com/gist)"
STRICT_URL = (
    "(?i)^" + HOST
    + "(?!orgs/|settings/|marketplace/|features/|pricing/|login/|signup/|gist/|gists/)"
    + r"([^/?#\s]+)/([^/?#\s]+?)(?:\.git)?(?:[/?#].*)?\z"
)
TRACKED_URL = "^" + HOST + r"([^/]+)/([^/]+?)(?:\.git)?/?\z"
PREFLIGHT_URL = r"^https?://(www\.)?github\.com/[^/]+/[^/]+"


def is_gist_url(url: Column) -> Column:
    return trimmed(url).rlike(GIST_PREFIX)


def url_error(url: Column) -> Column:
    """Why the strict parse rejects a URL, null when it is accepted."""
    clean = trimmed(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "INVALID_URL")
        .when(clean.rlike(GIST_PREFIX), "GIST_NOT_SUPPORTED")
        .when(~clean.rlike(STRICT_URL), "INVALID_URL")
    )


def strict_owner(url: Column) -> Column:
    return F.when(url_error(url).isNull(), F.regexp_extract(trimmed(url), STRICT_URL, 1))


def strict_repo(url: Column) -> Column:
    return F.when(url_error(url).isNull(), F.regexp_extract(trimmed(url), STRICT_URL, 2))


def preflight_error(url: Column) -> Column:
    """Cheap check before anything else is looked up; null when it passes."""
    return F.when(F.coalesce(url, F.lit("")) == "", "MISSING_REPO_URL").when(
        ~trimmed(url).rlike(PREFLIGHT_URL), "INVALID_REPO_URL"
    )


def tracked_repository(url: Column) -> Column:
    """Anchored parse to ``struct<owner, name, full_name, url>``, null without a match."""
    clean = trimmed(url)
    owner = F.regexp_extract(clean, TRACKED_URL, 1)
    name = F.regexp_extract(clean, TRACKED_URL, 2)
    full_name = F.concat(owner, F.lit("/"), name)
    return F.when(
        clean.rlike(TRACKED_URL),
        F.struct(
            owner.alias("owner"),
            name.alias("name"),
            full_name.alias("full_name"),
            F.concat(F.lit("https://github.com/"), full_name).alias("url"),
        ),
    )
