"""Language detection and the linter plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import paths as P
from reviewloom.functions.json_values import computed_once
from reviewloom.operators.files import is_manifest_visible, walk, walkable

# The linter registry in its order
# (language, linter, flag, extensions, manifests).
REGISTRY = (
    ("javascript", "eslint", "runJavaScript",
     (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), ("package.json",)),
    ("python", "flake8", "runPython",
     (".py",), ("pyproject.toml", "requirements.txt", "setup.py")),
    ("rust", "clippy", "runRust", (".rs",), ("Cargo.toml",)),
    ("go", "golangci-lint", "runGo", (".go",), ("go.mod",)),
    ("java", "checkstyle", "runJava",
     (".java",), ("pom.xml", "build.gradle", "build.gradle.kts")),
    ("ruby", "rubocop", "runRuby", (".rb",), ("Gemfile", ".rubocop.yml")),
    ("php", "phpcs", "runPhp", (".php",), ("composer.json", "composer.lock")),
    ("cpp", "cppcheck", "runCpp",
     (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"), ("CMakeLists.txt", "Makefile")),
    ("swift", "swiftlint", "runSwift", (".swift",), ("Package.swift", ".swiftlint.yml")),
    ("kotlin", "ktlint", "runKotlin",
     (".kt", ".kts"), ("build.gradle.kts", "build.gradle", "settings.gradle.kts")),
    ("shell", "shellcheck", "runShell", (".sh", ".bash", ".zsh", ".ksh"), ()),
    ("sql", "sqlfluff", "runSql", (".sql", ".psql", ".ddl"), ()),
    ("mongodb", "mongodb-analyzer", "runMongodb", (".js", ".ts", ".mjs", ".cjs"), ()),
)

# Hints that a repository's SQL is PostgreSQL.
POSTGRES_PACKAGES = ("pg", "pg-promise", "postgres", "pgp")
POSTGRES_REQUIREMENTS = "psycopg|asyncpg|aiopg"


def registry_table(spark: SparkSession, registry: Sequence[tuple] = REGISTRY) -> DataFrame:
    """The registry as a small dimension table; add rows to plug in another linter."""
    rows = [
        (position, language, linter, flag, list(extensions), list(manifests))
        for position, (language, linter, flag, extensions, manifests) in enumerate(registry)
    ]
    return spark.createDataFrame(
        rows,
        "registry_pos int, language string, linter string, flag string, "
        "extensions array<string>, manifests array<string>",
    )


def registry_extensions(registry: DataFrame) -> DataFrame:
    """Distinct extensions of all registry entries."""
    return registry.select(F.explode("extensions").alias("ext")).distinct()


def _extension_list(registry: Sequence[tuple]) -> list[str]:
    return sorted({ext for entry in registry for ext in entry[3]})



def extension_counts(
    files: DataFrame, registry: Sequence[tuple] = REGISTRY, max_files: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """File count per repository and registry extension, zeros included."""
    extensions = _extension_list(registry)
    listing = walk(files, extensions, max_files, max_depth)
    counted = (
        listing.select("repo_id", P.extension(F.col("path")).alias("ext"))
        .groupBy("repo_id", "ext").agg(F.count(F.lit(1)).alias("n"))
    )
    # One map entry per registry extension and repository, never per file.
    repos = files.select("repo_id").distinct()
    zero = repos.select(
        "repo_id", F.explode(F.array(*[F.lit(e) for e in extensions])).alias("ext")
    )
    return zero.join(counted, ["repo_id", "ext"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )


def _languages_by_extension(listing: DataFrame, registry: Sequence[tuple]) -> DataFrame:
    """One row per repository and language found through a file extension."""
    ext = F.col("ext")
    hits = F.array_compact(
        F.array(*[
            F.when(ext.isin(*extensions), language)
            for language, _, _, extensions, _ in registry if extensions
        ])
    )
    present = listing.select("repo_id", P.extension(F.col("path")).alias("ext")).distinct()
    return present.select("repo_id", F.explode(hits).alias("language"))


def _languages_by_manifest(files: DataFrame, registry: Sequence[tuple]) -> DataFrame:
    """One row per repository and language found through a manifest.

    A manifest counts as a file in any visible directory, or as anything at the root.
    """
    path = F.col("path")
    visible = is_manifest_visible(path)
    base = P.base_name(path)
    top = F.substring_index(path, "/", 1)
    hits = F.array_compact(
        F.array(*[
            F.when((visible & base.isin(*manifests)) | top.isin(*manifests), language)
            for language, _, _, _, manifests in registry if manifests
        ])
    )
    # The outer generator keeps Spark from testing every path twice.
    found = files.select("repo_id", F.explode_outer(hits).alias("language"))
    return found.where(F.col("language").isNotNull())


def detect_languages(
    files: DataFrame, registry: Sequence[tuple] = REGISTRY, max_files: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """``repo_id, language, registry_pos`` for every language present.

    A repository with JavaScript also gets the built-in MongoDB analyzer.
    """
    listing = walk(files, _extension_list(registry), max_files, max_depth)
    found = _languages_by_extension(listing, registry).unionByName(
        _languages_by_manifest(files, registry)
    )
    names = [entry[0] for entry in registry]
    forced = F.array(F.col("language"), F.lit("mongodb"))
    if "mongodb" in names:
        found = found.select(
            "repo_id",
            F.explode(
                F.when(F.col("language") == "javascript", forced)
                .otherwise(F.array("language"))
            ).alias("language"),
        )
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("language")) - 1
    return found.distinct().withColumn("registry_pos", position.cast("int"))


def linter_plan(
    detections: DataFrame,
    registry: DataFrame,
    flags: Mapping[str, bool] | None = None,
    languages: DataFrame | None = None,
) -> DataFrame:
    """Linters to run per repository: languages (detected, or the given override table)
    joined with the enabled registry entries."""
    disabled = [flag for flag, enabled in (flags or {}).items() if not enabled]
    enabled = registry.where(~F.col("flag").isin(*disabled)) if disabled else registry
    selected = languages if languages is not None else detections
    # The registry is a handful of literal rows, so its broadcast size is fixed.
    return selected.select("repo_id", "language").distinct().join(
        F.broadcast(enabled.select("language", "linter", "registry_pos")), "language"
    )


def manifest_languages(files: DataFrame, registry: Sequence[tuple] = REGISTRY) -> DataFrame:
    return _languages_by_manifest(files, registry).distinct()


def sql_dialects(files: DataFrame) -> DataFrame:
    """PostgreSQL or generic SQL per repository.

    Only the two root manifests are parsed; every other row contributes its path.
    """
    path = F.col("path")
    names = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    # Parsed once: the generator keeps the parse below the tests that read it.
    package = F.when(path == "package.json", F.from_json("content", names, {"allowSingleQuotes": "false"}))
    is_pg = F.lit(False)
    for name in POSTGRES_PACKAGES:
        for group in ("dependencies", "devDependencies"):
            is_pg = is_pg | F.coalesce(
                F.map_contains_key(F.col(f"package.{group}"), F.lit(name)), F.lit(False)
            )
    psql = walkable(files, [".psql"]).select("repo_id", F.lit(True).alias("pg"))
    roots = files.where(path.isin("package.json", "requirements.txt"))
    manifests = computed_once(roots, "package", package).select(
        "repo_id",
        F.when(path == "package.json", is_pg)
        .otherwise(F.coalesce(F.col("content").rlike(POSTGRES_REQUIREMENTS), F.lit(False)))
        .alias("pg"),
    )
    every = files.select("repo_id", F.lit(False).alias("pg"))
    signals = reduce(DataFrame.unionByName, [psql, manifests, every])
    return signals.groupBy("repo_id").agg(
        F.when(F.bool_or("pg"), "postgres").otherwise("ansi").alias("dialect")
    )

