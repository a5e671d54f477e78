"""Source-file listings over a ``files(repo_id, path, ...)`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import paths as P
from reviewloom.operators.ranking import top_k

CAP_WARNING = (
    f"File count reached the cap of {P.MAX_FILES}. Scan stopped early — "
    "some files may not have been reviewed."
)


def walkable(
    files: DataFrame,
    extensions: Sequence[str] | None = None,
    max_depth: int | None = P.MAX_DEPTH,
    skip_hidden: bool = True,
) -> DataFrame:
    """Files a walk visits: not ignored, not too deep (``None``: any depth), optionally of given extensions."""
    path = F.col("path")
    kept = files.where(~P.in_ignored_directory(path, skip_hidden) & ~P.is_ignored_file(path))
    if max_depth is not None:
        kept = kept.where(P.depth(path) <= max_depth)
    if extensions is not None:
        kept = kept.where(P.extension(path).isin(*[e.lower() for e in extensions]))
    return kept


def capped(files: DataFrame, max_files: int = P.MAX_FILES) -> DataFrame:
    """The first ``max_files`` paths of each repository in binary path order.

    Works on ``repo_id, path`` only, so no file content is shuffled. Join back where
    content is needed.
    """
    listed = files.select("repo_id", "path")
    return top_k(listed, ["repo_id"], [F.col("path")], max_files, "position").drop("position")


def walk(
    files: DataFrame, extensions: Sequence[str] | None = None, max_files: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """``repo_id, path`` of walkable files; without ``max_files`` and ``max_depth`` of all of them."""
    kept = walkable(files, extensions, max_depth)
    return kept.select("repo_id", "path") if max_files is None else capped(kept, max_files)


def source_files(files: DataFrame, max_files: int = P.MAX_FILES) -> DataFrame:
    return walk(files, P.SOURCE_EXTENSIONS, max_files, P.MAX_DEPTH)


def walk_with_content(
    files: DataFrame, extensions: Sequence[str] | None = None, max_files: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """The walked files with all their columns; without ``max_files`` none is left out.

    Only a repository over the cap needs a cut: the path at the cap position. The cuts
    (at most one per ``max_files`` files) are found on paths alone and joined back; whether
    by broadcast is left to the adaptive planner, which knows their size.
    """
    kept = walkable(files, extensions, max_depth)
    if max_files is None:
        return kept
    cuts = (
        top_k(kept.select("repo_id", "path"), ["repo_id"], [F.col("path")], max_files, "position")
        .where(F.col("position") == max_files)
        .select("repo_id", F.col("path").alias("cut"))
    )
    return (
        kept.join(cuts, "repo_id", "left")
        .where(F.col("cut").isNull() | (F.col("path") <= F.col("cut")))
        .drop("cut")
    )


def scan_stats(listing: DataFrame, max_files: int = P.MAX_FILES) -> DataFrame:
    """Totals of a capped listing, whether it hit the cap, and the warning text."""
    stopped = F.col("total_files") >= max_files
    warning = CAP_WARNING.replace(str(P.MAX_FILES), str(max_files), 1)
    return (
        listing.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
        .withColumn("stopped_early", stopped)
        .withColumn("warning", F.when(stopped, warning))
    )


def is_manifest_visible(path: Column) -> Column:
    """Paths a manifest search can see: directories pruned, dot-files kept, one level deeper."""
    return ~P.in_ignored_directory(path) & (P.depth(path) <= P.MAX_DEPTH + 1)


def manifest_directories(files: DataFrame, *names: str) -> DataFrame:
    """Distinct directories (empty for the root) that contain one of the manifests."""
    path = F.col("path")
    return (
        files.where(is_manifest_visible(path) & P.base_name(path).isin(*names))
        .select(
            "repo_id", P.base_name(path).alias("manifest"), P.parent_directory(path).alias("directory")
        )
        .distinct()
    )
