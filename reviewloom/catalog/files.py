"""Source-tree, language and linter-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.functions import paths as P
from reviewloom.operators import files as fl, languages as lang
from reviewloom.session import scratch_dir
from reviewloom.sources import trees
from reviewloom.sources.samples import Samples


def path_parts(spark, sf_dir):
    path = F.col("path")
    return Samples(spark, sf_dir).view("files").select(
        "repo_id", "path", P.extension(path).alias("ext"), P.base_name(path).alias("base"),
        P.parent_directory(path).alias("directory"), P.depth(path).cast("int").alias("depth"),
        P.in_ignored_directory(path).alias("ignored_dir"), P.is_ignored_file(path).alias("ignored_file"),
        P.relative_path(F.lit("/w/"), F.concat(F.lit("/w/"), path)).alias("relative"),
    )


def source_listing(spark, sf_dir):
    return fl.source_files(Samples(spark, sf_dir).view("files"))


def tree_listing(spark, sf_dir):
    """Files unpacked as a source tree, listed without opening ignored directories, then read."""
    root = scratch_dir(spark, "source-tree")
    trees.write_source_tree(Samples(spark, sf_dir).view("files"), root)
    listing = trees.list_source_tree(spark, root, extensions=P.SOURCE_EXTENSIONS)
    return trees.with_contents(listing, root).select("repo_id", "path", F.md5("content").alias("digest"))


def file_cap(spark, sf_dir):
    return fl.source_files(Samples(spark, sf_dir).view("files"), max_files=5)


def listing_with_content(spark, sf_dir):
    rows = fl.walk_with_content(
        Samples(spark, sf_dir).view("files"), P.SOURCE_EXTENSIONS, max_files=5
    )
    return rows.select("repo_id", "path", F.length("content").cast("int").alias("chars"))


def scan_stats(spark, sf_dir):
    return fl.scan_stats(fl.source_files(Samples(spark, sf_dir).view("files"), 5), 5)


def manifest_dirs(spark, sf_dir):
    return fl.manifest_directories(Samples(spark, sf_dir).tree(), "package.json", ".rubocop.yml")


def ext_counts(spark, sf_dir):
    return lang.extension_counts(Samples(spark, sf_dir).tree())


def manifest_languages(spark, sf_dir):
    return lang.manifest_languages(Samples(spark, sf_dir).tree())


def language_detect(spark, sf_dir):
    return lang.detect_languages(Samples(spark, sf_dir).tree())


def linter_plan(spark, sf_dir):
    detections = lang.detect_languages(Samples(spark, sf_dir).tree())
    registry = lang.registry_table(spark)
    return lang.linter_plan(detections, registry, {"runSql": False, "runGo": True})


def linter_plan_override(spark, sf_dir):
    """Languages chosen by hand instead of the detected ones."""
    s = Samples(spark, sf_dir)
    chosen = s.view("files").select(
        "repo_id", F.explode(F.array(F.lit("python"), F.lit("cobol"))).alias("language")
    )
    return lang.linter_plan(lang.detect_languages(s.tree()), lang.registry_table(spark),
                            languages=chosen)


def registry_extensions(spark, sf_dir):
    """Registry extensions with the number of files that carry each."""
    s = Samples(spark, sf_dir)
    listed = s.view("files").select(P.extension(F.col("path")).alias("ext"))
    counted = listed.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    wanted = lang.registry_extensions(lang.registry_table(spark))
    return wanted.join(counted, "ext", "left").fillna(0, ["n"])


def sql_dialect(spark, sf_dir):
    return lang.sql_dialects(Samples(spark, sf_dir).view("dialect_files"))


_DIRS = (
    "node_modules|\\.git|dist|build|target|__pycache__|\\.venv|venv|\\.pytest_cache|coverage|\\.next|"
    "\\.nuxt|\\.cache|\\.turbo|\\.idea|\\.vscode|vendor|tmp|temp|\\.[^/]*|"
)
_IGNORED_DIR = f"regexp_matches(path, '(^|/)({_DIRS})/')"
_BASE = "regexp_extract(path, '[^/]*$')"
_IGNORED_FILE = (
    f"({_BASE} = '' OR starts_with({_BASE}, '.') OR ends_with({_BASE}, '.min.js') OR "
    f"ends_with({_BASE}, '.min.css') OR ends_with({_BASE}, '.map') OR ends_with({_BASE}, '.lock'))"
)
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"
_DEPTH = "length(path) - length(replace(path, '/', ''))"
_WALK = f"NOT {_IGNORED_DIR} AND NOT {_IGNORED_FILE} AND {_DEPTH} <= 20"
_SOURCE = ", ".join(f"'{e}'" for e in P.SOURCE_EXTENSIONS)
_ALL_EXT = sorted({e for entry in lang.REGISTRY for e in entry[3]})


def _listed(view: str, extensions: str, cap: int) -> str:
    return (
        f"l AS (SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id "
        f"ORDER BY path) AS rn FROM fx_{view} WHERE {_WALK} AND {_EXT} IN ({extensions})) t WHERE rn <= {cap})"
    )


_REGISTRY_EXT = ", ".join(
    f"('{language}', {pos}, '{ext}')"
    for pos, (language, _, _, extensions, _) in enumerate(lang.REGISTRY) for ext in extensions
)
_REGISTRY_MANIFEST = ", ".join(
    f"('{language}', {pos}, '{name}')"
    for pos, (language, _, _, _, manifests) in enumerate(lang.REGISTRY) for name in manifests
)
_BY_MANIFEST = (
    f"mr AS (SELECT * FROM (VALUES {_REGISTRY_MANIFEST}) v(language, registry_pos, name)), "
    f"bm AS (SELECT DISTINCT t.repo_id, language, registry_pos FROM fx_tree t JOIN mr ON "
    f"({_BASE} = name AND NOT {_IGNORED_DIR} AND {_DEPTH} <= 21) "
    "OR string_split(path, '/')[1] = name)"
)
_DETECT = (
    _listed("tree", ", ".join(f"'{e}'" for e in _ALL_EXT), 5000) + ", "
    f"er AS (SELECT * FROM (VALUES {_REGISTRY_EXT}) v(language, registry_pos, ext)), "
    + _BY_MANIFEST +
    f", f0 AS (SELECT DISTINCT repo_id, language, registry_pos FROM l JOIN er ON er.ext = {_EXT} "
    "UNION SELECT * FROM bm), "
    "det AS (SELECT * FROM f0 UNION SELECT repo_id, 'mongodb', 12 FROM f0 WHERE language = 'javascript')"
)
_LINTERS = ", ".join(
    f"('{language}', '{linter}', {pos}, '{flag}')"
    for pos, (language, linter, flag, _, _) in enumerate(lang.REGISTRY)
)

QUERIES = {
    "path_parts": path_parts,
    "source_listing": source_listing,
    "tree_listing": tree_listing,
    "file_cap": file_cap,
    "listing_with_content": listing_with_content,
    "scan_stats": scan_stats,
    "manifest_dirs": manifest_dirs,
    "ext_counts": ext_counts,
    "manifest_languages": manifest_languages,
    "language_detect": language_detect,
    "linter_plan": linter_plan,
    "linter_plan_override": linter_plan_override,
    "registry_extensions": registry_extensions,
    "sql_dialect": sql_dialect,
}

ORACLES = {
    "path_parts": oracle(
        f"SELECT repo_id, path, {_EXT} AS ext, {_BASE} AS base, "
        "regexp_replace(path, '/?[^/]*$', '') AS directory, "
        f"CAST({_DEPTH} AS INT) AS depth, {_IGNORED_DIR} AS ignored_dir, "
        f"{_IGNORED_FILE} AS ignored_file, path AS relative FROM fx_files", "files"),
    "source_listing": oracle("SELECT * FROM l", "files", ctes=_listed("files", _SOURCE, 5000)),
    "tree_listing": oracle(
        f"SELECT repo_id, path, md5(coalesce(content, '')) AS digest FROM fx_files WHERE {_WALK} AND {_EXT} IN ({_SOURCE})",
        "files"),
    "file_cap": oracle("SELECT * FROM l", "files", ctes=_listed("files", _SOURCE, 5)),
    "listing_with_content": oracle(
        "SELECT l.repo_id, l.path, CAST(length(content) AS INT) AS chars FROM l "
        "JOIN fx_files f ON f.repo_id = l.repo_id AND f.path = l.path",
        "files", ctes=_listed("files", _SOURCE, 5)),
    "scan_stats": oracle(
        "SELECT repo_id, count(*) AS total_files, count(*) >= 5 AS stopped_early, "
        "CASE WHEN count(*) >= 5 THEN 'File count reached the cap of 5. Scan stopped early — some "
        "files may not have been reviewed.' END AS warning FROM l GROUP BY repo_id",
        "files", ctes=_listed("files", _SOURCE, 5)),
    "manifest_dirs": oracle(
        f"SELECT DISTINCT repo_id, {_BASE} AS manifest, regexp_replace(path, '/?[^/]*$', '') AS directory "
        f"FROM fx_tree WHERE {_BASE} IN ('package.json', '.rubocop.yml') AND NOT {_IGNORED_DIR} "
        f"AND {_DEPTH} <= 21", "tree"),
    "ext_counts": oracle(
        "SELECT r.repo_id, e.ext, coalesce(n, 0) AS n FROM (SELECT DISTINCT repo_id FROM fx_tree) r "
        f"CROSS JOIN (SELECT unnest([{', '.join(repr(e) for e in _ALL_EXT)}]) AS ext) e LEFT JOIN "
        f"(SELECT repo_id, {_EXT} AS ext, count(*) AS n FROM l GROUP BY ALL) c "
        "ON c.repo_id = r.repo_id AND c.ext = e.ext", "tree",
        ctes=_listed("tree", ", ".join(f"'{e}'" for e in _ALL_EXT), 5000)),
    "manifest_languages": oracle(
        "SELECT repo_id, language FROM bm", "tree", ctes=_BY_MANIFEST),
    "language_detect": oracle(
        "SELECT repo_id, language, CAST(registry_pos AS INT) AS registry_pos FROM det", "tree",
        ctes=_DETECT),
    "linter_plan": oracle(
        "SELECT det.repo_id, det.language, g.linter, CAST(g.pos AS INT) AS registry_pos FROM det "
        f"JOIN (VALUES {_LINTERS}) g(language, linter, pos, flag) ON g.language = det.language "
        "WHERE flag <> 'runSql'", "tree", ctes=_DETECT),
    "linter_plan_override": oracle(
        "SELECT DISTINCT repo_id, 'python' AS language, 'flake8' AS linter, 1 AS registry_pos "
        "FROM fx_files", "files"),
    "registry_extensions": oracle(
        f"SELECT e.ext, count(f.path) AS n FROM (SELECT unnest([{', '.join(repr(e) for e in _ALL_EXT)}]) "
        f"AS ext) e LEFT JOIN fx_files f ON {_EXT} = e.ext GROUP BY e.ext", "files"),
    "sql_dialect": oracle(
        "SELECT repo_id, CASE WHEN bool_or(CASE WHEN path = 'package.json' THEN content LIKE '%\"pg\"%' "
        "WHEN path = 'requirements.txt' THEN regexp_matches(content, 'psycopg|asyncpg|aiopg') "
        "ELSE path = 'db/x.psql' END) THEN 'postgres' ELSE 'ansi' END AS dialect "
        "FROM fx_dialect_files GROUP BY repo_id", "dialect_files"),
}
