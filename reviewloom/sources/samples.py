"""Review tables derived from the provided star-schema tables.

The provided data has no review history, so each canonical table is a projection of it:
orders act as reviews of their customer's repository, line items as findings, documents as
source files, pages as raw URLs and events as model responses. Every view grows with its
table and is row-local or a combinable aggregate.

``ROW_VIEWS`` holds the row-local ones as plain SQL select lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.languages import REGISTRY
from reviewloom.sources.tables import spread

LINTERS = [entry[1] for entry in REGISTRY]


def _linter_of(key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LINTERS))
    return f"CASE {key} % {len(LINTERS)} {cases} END"


_GOOD_ISSUE = (
    "concat('{\"file\":\"src/m', CAST(l_suppkey % 8 AS STRING), '.js\",\"line\":', "
    "CAST(l_linenumber AS STRING), ',\"severity\":\"error\",\"category\":\"logic\","
    "\"message\":\"m', CAST(l_suppkey % 3 AS STRING), '\",\"suggestion\":\"s\"}')"
)
_ODD_ISSUE = "'{\"file\":3,\"line\":\"7\",\"severity\":\"bad\",\"category\":\"x\"}'"

# File names of the whole jobs by document: one for each tool, two that no walk keeps, one more.
JOB_EXTENSIONS = (
    ".js", ".py", ".rs", ".go", ".java", ".rb", ".php", ".cpp", ".swift", ".kt", ".sh", ".SQL", ".min.js", ".png", ".ts",
)
_JOB_CASES = " ".join(f"WHEN {k} THEN '{ext}'" for k, ext in enumerate(JOB_EXTENSIONS))

# view -> (table, select list)
ROW_VIEWS: dict[str, tuple[str, list[str]]] = {
    # Line items as findings; seq packs the line number and tie-breakers.
    "findings": ("lineitem", [
        "l_orderkey AS review_id",
        "CAST(l_linenumber AS BIGINT) * 1000000000000 + (l_partkey % 1000000) * 1000000 "
        "+ (l_suppkey % 1000) * 1000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS seq",
        "concat('src/m', CAST(l_partkey % 8 AS STRING), '.js') AS file",
        "CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS line",
        "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END "
        "AS severity",
        "CASE l_suppkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'lint' WHEN 2 THEN 'style' "
        "WHEN 3 THEN 'logic' ELSE 'performance' END AS category",
        "concat('msg-', CAST(l_suppkey % 3 AS STRING)) AS message",
        "CASE WHEN l_partkey % 3 = 0 THEN concat('fix-', CAST(l_suppkey % 3 AS STRING)) "
        "ELSE '' END AS suggestion",
        "concat('rule/', CAST(l_suppkey % 5 AS STRING)) AS rule_id",
    ]),
    # Line items as findings of long histories: sixteen orders a round, every third round in one
    # repository. The same rows, grouped, are the changes of the round.
    "long_findings": ("lineitem", [
        "CAST(floor(l_orderkey / 16) AS BIGINT) AS review_id",
        "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq",
        "concat('src/f', CAST(l_partkey % 400 AS STRING), '.js') AS file",
        "CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS line",
        "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity",
        "'lint' AS category",
        "concat('msg-', CAST(l_suppkey % 2 AS STRING)) AS message",
    ]),
    "long_rounds": ("orders", [
        "CAST(floor(o_orderkey / 16) AS BIGINT) AS review_id",
        "CASE WHEN CAST(floor(o_orderkey / 16) AS BIGINT) % 3 = 0 THEN 0 "
        "ELSE CAST(floor(o_orderkey / 16) AS BIGINT) % 40 + 1 END AS repo_id",
        "CASE WHEN CAST(floor(o_orderkey / 16) AS BIGINT) % 100 = 7 THEN 'full' ELSE 'incremental' END AS mode",
        "to_timestamp(946684800 + 86400 * CAST(floor(o_orderkey / 48) AS BIGINT)) AS created_at",
    ]),
    "files": ("documents", [
        "source AS repo_id",
        "concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' "
        "WHEN doc_id % 13 = 0 THEN 'src/.hidden/' ELSE 'src/' END, lang, '/f', "
        "CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.py' "
        "WHEN 2 THEN '.SQL' WHEN 3 THEN '.min.js' WHEN 4 THEN '.png' ELSE '.ts' END) AS path",
        "text AS content",
    ]),
    # Manifests next to some of the files (paths only).
    "manifests": ("documents", [
        "source AS repo_id",
        "concat(CASE WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 5 = 0 THEN '' "
        "ELSE concat('mod', CAST(doc_id % 9 AS STRING), '/') END, "
        "CASE doc_id % 7 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' "
        "WHEN 2 THEN 'go.mod' WHEN 3 THEN '.rubocop.yml' WHEN 4 THEN 'Makefile/readme.txt' "
        "ELSE 'notes.txt' END) AS path",
    ]),
    # Root manifests with content, for the dialect detection.
    "dialect_files": ("documents", [
        "concat('doc', CAST(doc_id AS STRING)) AS repo_id",
        "CASE doc_id % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' "
        "WHEN 2 THEN 'db/x.psql' WHEN 3 THEN 'vendor/x.psql' ELSE 'package.json' END AS path",
        "CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 "
        "THEN '{\"dependencies\":{\"pg\":\"1\"}}' ELSE '{\"devDependencies\":{\"page\":\"1\"}}' END "
        "WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN concat('psycopg2', chr(10), lang) ELSE text END "
        "WHEN 4 THEN 'not json' ELSE text END AS content",
    ]),
    # Documents rewritten so that the database rules have something to find.
    "code_files": ("documents", [
        "source AS repo_id",
        "concat('src/', lang, '/f', CAST(doc_id AS STRING), '.js') AS path",
        "concat(CASE WHEN doc_id % 3 <> 0 THEN concat('const m = require(\"mongoose\");', "
        "chr(10)) ELSE '' END, "
        "replace(replace(replace(replace(replace(replace(text, '. ', chr(10)), ' the ', "
        "' User.find({}) '), ' of ', ' $where : '), ' is ', '.lean () '), ' que ', "
        "' new ObjectId( ) '), ' der ', concat(chr(10), '  // x.drop() '))) AS content",
    ]),
    # Documents under names that include skipped files and committed env files.
    "secret_files": ("documents", [
        "source AS repo_id",
        "concat('d', CAST(doc_id AS STRING), CASE WHEN doc_id % 50 = 0 THEN '/.env' "
        "WHEN doc_id % 10 = 1 THEN '/README.md' WHEN doc_id % 10 = 2 THEN '/.env.example' "
        "ELSE '/config.js' END) AS path",
        "text AS content",
    ]),
    # One repository of one file for each document, for the whole jobs; see JOB_EXTENSIONS.
    "job_files": ("documents", [
        "concat('doc', CAST(doc_id AS STRING)) AS repo_id",
        "concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' "
        "WHEN doc_id % 13 = 0 THEN 'src/.hidden/' ELSE 'src/' END, lang, '/f', "
        f"CAST(doc_id AS STRING), CASE doc_id % 15 {_JOB_CASES} END) AS path",
        "CASE WHEN doc_id % 15 IN (0, 14) AND doc_id % 4 < 3 THEN concat('import mongoose', chr(10), "
        "'User.find({})', chr(10), text) ELSE text END AS content",
    ]),
    "job_metadata": ("documents", [
        "concat('doc', CAST(doc_id AS STRING)) AS repo_id",
        "doc_id % 11 = 0 AS archived", "false AS disabled", "false AS fork", "false AS private",
        "CAST(100 AS BIGINT) AS size_kb", "'main' AS default_branch", "true AS has_commits",
        "CAST(NULL AS INT) AS rate_remaining",
        "CASE WHEN doc_id % 17 = 3 THEN 404 ELSE 200 END AS http_status",
        "CAST(NULL AS STRING) AS response_message", "true AS has_token",
    ]),
    "repo_urls": ("pages", [
        "page_id",
        "CASE page_id % 5 WHEN 0 THEN url "
        "WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', 'https://github.com') "
        "WHEN 2 THEN concat(regexp_replace(url, '^https?://[^/]+', 'github.com'), '.git') "
        "WHEN 3 THEN regexp_replace(url, '^https?://[^/]+', 'https://github.com/orgs') "
        "ELSE regexp_replace(url, '^https?://[^/]+', 'https://gist.github.com') END AS raw_url",
    ]),
    "metadata": ("customer", [
        "c_custkey AS repo_id",
        "c_custkey % 11 = 0 AS archived",
        "c_custkey % 17 = 0 AS disabled",
        "c_custkey % 5 = 0 AS fork",
        "c_custkey % 3 = 0 AS private",
        "CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal) * 100) AS BIGINT) "
        "% 700000 END AS size_kb",
        "CASE WHEN c_custkey % 29 <> 0 THEN 'main' END AS default_branch",
        "c_custkey % 19 <> 0 AS has_commits",
        "CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 61 AS INT) END AS rate_remaining",
        "CASE c_custkey % 13 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 401 WHEN 3 THEN 500 "
        "ELSE 200 END AS http_status",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Resource not accessible' END AS response_message",
        "c_custkey % 4 = 0 AS has_token",
    ]),
    "api_calls": ("events", [
        "event_id AS call_id",
        "CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'metadata' WHEN 2 THEN 'commits' "
        "WHEN 3 THEN 'head' WHEN 4 THEN 'compare' ELSE 'zipball' END AS endpoint",
        "CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 409 "
        "WHEN 4 THEN 503 ELSE 200 END AS http_status",
    ]),
    # One request per customer: some forced, some with an unchanged head.
    "requests": ("customer", [
        "c_custkey AS repo_id",
        "c_custkey % 10 = 0 AS force_full",
        "c_custkey % 4 = 1 AS same_head",
        "CASE c_custkey % 6 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS compare_status",
        "CASE c_custkey % 3 WHEN 0 THEN ' release ' WHEN 1 THEN '  ' END AS branch",
    ]),
    "responses": ("events", [
        "event_id AS response_id",
        "CASE event_id % 4 WHEN 0 THEN concat('{\"summary\":\"', event_type, "
        "'\",\"score\":', CAST(event_id % 140 AS STRING), ',\"issues\":[]}') "
        "WHEN 1 THEN concat('```json', chr(10), '{\"summary\":\"', event_type, "
        "'\",\"score\":\"', CAST(event_id % 140 AS STRING), '\"}', chr(10), '```') "
        "WHEN 2 THEN concat('Here is the review: ', props, ' done') "
        "ELSE concat('no json ', event_type) END AS text",
    ]),
    # One response per line item, covering valid, malformed and odd issue lists.
    "issue_responses": ("lineitem", [
        "l_orderkey AS review_id",
        f"CASE l_partkey % 8 WHEN 0 THEN concat('{{\"summary\":\"ok\",\"score\":72.5,\"issues\":[', "
        f"{_GOOD_ISSUE}, ',', {_ODD_ISSUE}, ']}}') "
        f"WHEN 1 THEN concat('```json', chr(10), '{{\"score\":140,\"issues\":[', {_GOOD_ISSUE}, "
        f"']}}', chr(10), '```') "
        f"WHEN 2 THEN concat('Result: {{\"score\":-3,\"issues\":[', {_ODD_ISSUE}, ']}} end') "
        "WHEN 3 THEN '{\"summary\":7,\"score\":60,\"issues\":[3]}' "
        "WHEN 4 THEN '{\"issues\":\"x\"}' WHEN 5 THEN '[]' "
        "WHEN 6 THEN '{\"score\":10,\"issues\":[null]}' "
        "ELSE '{\"score\":1} tail {\"score\":2}' END AS text",
    ]),
    # One fix answer per order.
    "fix_responses": ("orders", [
        "o_orderkey AS review_id",
        "CASE o_orderkey % 5 WHEN 0 THEN concat('{\"prTitle\":\"Fix ', "
        "CAST(o_orderkey AS STRING), '\",\"prBody\":\"Body\",\"fixes\":[{\"file\":\"src/m', "
        "CAST(o_custkey % 8 AS STRING), '.js\",\"newContent\":\"x\",\"explanation\":\"why\"},"
        "{\"file\":\"src/b.js\",\"newContent\":\"y\"},{\"file\":\"src/c.js\"}]}') "
        "WHEN 1 THEN concat('```json', chr(10), '{\"prBody\":\"B\",\"fixes\":"
        "[{\"file\":\"a.js\",\"newContent\":\"z\"}]}', chr(10), '```') "
        "WHEN 2 THEN '{\"prTitle\":5,\"fixes\":[{\"newContent\":\"q\"}]}' "
        "WHEN 3 THEN 'sorry' ELSE '{\"fixes\":{}}' END AS text",
    ]),
    # Two attempts per order.
    "first_attempts": ("orders", [
        "o_orderkey AS review_id", "'primary' AS provider", "0 AS attempt_pos",
        "CASE o_orderkey % 4 WHEN 0 THEN concat(' answer ', CAST(o_orderkey AS STRING)) "
        "WHEN 1 THEN '  ' END AS text",
        "CASE o_orderkey % 4 WHEN 2 THEN 'Rate limit reached' WHEN 3 THEN 'timeout' END AS error",
        "CASE WHEN o_orderkey % 8 = 3 THEN 429 END AS status",
    ]),
    "second_attempts": ("orders", [
        "o_orderkey AS review_id", "'fallback' AS provider", "1 AS attempt_pos",
        "CASE WHEN o_custkey % 3 <> 0 THEN concat('second ', CAST(o_custkey AS STRING)) END "
        "AS text",
        "CASE WHEN o_custkey % 3 = 0 THEN 'offline' END AS error",
        "CAST(NULL AS INT) AS status",
    ]),
    # One linter run per order.
    "run_log": ("orders", [
        "o_orderkey AS repo_id",
        f"{_linter_of('o_orderkey')} AS linter",
        "o_orderkey % 11 <> 0 AS ran",
        "CASE o_orderkey % 7 WHEN 0 THEN 'ENOENT' WHEN 1 THEN 'ERR_INVALID_ARG_TYPE' END "
        "AS error_code",
        "CASE o_orderkey % 7 WHEN 2 THEN 'SyntaxError' WHEN 3 THEN 'Error' END AS error_name",
        "CASE WHEN o_orderkey % 7 < 4 THEN concat('failed ', CAST(o_orderkey AS STRING)) END "
        "AS error_message",
    ]),
    # Comparison payloads, one per order.
    "compares": ("orders", [
        "CAST(o_custkey AS STRING) AS repo_id",
        "CAST(o_orderkey AS STRING) AS review_id",
        "concat('b', CAST(o_custkey % 50 AS STRING)) AS base_sha",
        "concat('b', CAST(o_orderkey % 50 AS STRING)) AS head_sha",
        "concat('{\"status\":\"', CASE WHEN o_orderkey % 9 = 0 THEN 'identical' ELSE 'ahead' END, "
        "'\",\"behind_by\":', CAST(o_orderkey % 4 AS STRING), ',\"total_commits\":', "
        "CAST(o_orderkey % 6 AS STRING), ',\"files\":[{\"filename\":\"a', "
        "CAST(o_custkey % 8 AS STRING), '.js\",\"status\":\"modified\",\"patch\":\"+x\","
        "\"additions\":', CAST(o_custkey % 9 AS STRING), ',\"deletions\":1},"
        "{\"filename\":\"n.js\",\"previous_filename\":\"o.js\",\"status\":\"renamed\","
        "\"additions\":0,\"deletions\":0}]}') AS payload",
    ]),
}

# Select list of the changes of long histories, from a review, a file number and a kind.
LONG_CHANGES = [
    "review_id",
    "concat('src/f', CAST(k AS STRING), '.js') AS filename",
    "CASE WHEN s IN (3, 4) THEN concat('src/f', CAST(CASE WHEN k % 2 = 0 THEN k + 1 ELSE k - 1 END AS STRING), '.js') "
    "WHEN s = 5 THEN concat('src/f', CAST((k + 131) % 400 AS STRING), '.js') END AS previous_filename",
    "CASE s WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'renamed' END AS status",
]

# Views whose text is parsed or scanned.
PARSED_VIEWS = (
    "code_files", "secret_files", "responses", "issue_responses", "fix_responses", "compares",
)


class Samples:
    """Canonical tables over one folder of provided parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, view: str) -> DataFrame:
        """One of the row-local views; those that get parsed or scanned use all cores."""
        name, columns = ROW_VIEWS[view]
        table = self.table(name)
        return (spread(table) if view in PARSED_VIEWS else table).selectExpr(*columns)

    def reviews(self) -> DataFrame:
        """A customer's first order, and every seventh order, is a full review."""
        orders = self.table("orders")
        first = orders.groupBy("o_custkey").agg(
            F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")
        )
        # Joined on the unique order key, so a customer with many orders is no hot key.
        marked = orders.join(
            first.select(F.col("first.o_orderkey").alias("o_orderkey"), F.lit(True).alias("is_first")),
            "o_orderkey", "left",
        )
        key = F.col("o_orderkey")
        full = F.col("is_first").isNotNull() | (key % 7 == 0)
        return marked.select(
            key.alias("review_id"),
            F.col("o_custkey").alias("repo_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(full, "full").otherwise("incremental").alias("mode"),
            F.when(key % 13 != 0, ((key * 37) % 101).cast("int")).alias("score"),
            F.md5(key.cast("string")).alias("head_sha"),
            F.when(key % 3 == 0, "main").otherwise("develop").alias("branch"),
        )

    def issues(self) -> DataFrame:
        """Findings as stored issues, which carry no rule id."""
        return self.view("findings").drop("rule_id")

    def lint_findings(self) -> DataFrame:
        return self.view("findings")

    def changes(self) -> DataFrame:
        grouped = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("review_id"), F.expr("l_suppkey % 8").alias("k"))
            .agg(F.expr("min(l_linenumber + l_partkey) % 5").alias("s"))
        )
        return grouped.selectExpr(
            "review_id",
            "CAST(k AS INT) AS file_no",
            "concat('src/m', CAST(k AS STRING), '.js') AS filename",
            "CASE WHEN s = 3 THEN concat('src/m', CAST((k + 3) % 8 AS STRING), '.js') END "
            "AS previous_filename",
            "CASE s WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' "
            "WHEN 3 THEN 'renamed' ELSE 'modified' END AS status",
            "CASE WHEN k % 4 <> 0 THEN concat('@@ -1 +1 @@', chr(10), '+line ', "
            "CAST(k AS STRING)) END AS patch",
            "CAST(k + s AS INT) AS additions",
            "CAST(s AS INT) AS deletions",
        )

    def long_rounds(self) -> DataFrame:
        return self.view("long_rounds").distinct()

    def long_changes(self) -> DataFrame:
        """Changes of the long histories, more than half of them renames; some names swap for good."""
        return self.table("lineitem").groupBy(
            F.expr("CAST(floor(l_orderkey / 16) AS BIGINT)").alias("review_id"), F.expr("l_partkey % 400").alias("k")
        ).agg(F.expr("min(l_linenumber + l_suppkey) % 6").alias("s")).selectExpr(*LONG_CHANGES)

    def tree(self) -> DataFrame:
        """Paths of the files and of the manifests between them."""
        files = self.view("files").select("repo_id", "path")
        return files.unionByName(self.view("manifests").distinct())

    def attempts(self) -> DataFrame:
        return self.view("first_attempts").unionByName(self.view("second_attempts"))

    def lint_reports(self, linter: str) -> DataFrame:
        """One report of the given tool per line item (see :data:`PAYLOADS`)."""
        return spread(self.table("lineitem")).selectExpr(
            "CAST(l_orderkey AS STRING) AS repo_id",
            f"'{linter}' AS linter",
            "'/checkout/repo' AS root",
            f"CASE WHEN l_partkey % 10 = 0 THEN 'no report' ELSE {PAYLOADS[linter]} END AS payload",
        )

    def mixed_reports(self, repo: str = "CAST(l_orderkey AS STRING)", *further: str) -> DataFrame:
        """One report per line item, of each of the twelve tools in turn."""
        turn = "(l_orderkey + l_linenumber) % 12"
        payload = " ".join(f"WHEN {k} THEN {text}" for k, text in enumerate(PAYLOADS.values()))
        name = " ".join(f"WHEN {k} THEN '{linter}'" for k, linter in enumerate(PAYLOADS))
        return spread(self.table("lineitem")).selectExpr(
            f"{repo} AS repo_id", *further,
            f"CASE {turn} {name} END AS linter",
            "'/checkout/repo' AS root",
            f"CASE WHEN l_partkey % 10 = 0 THEN 'no report' ELSE CASE {turn} {payload} END END AS payload",
        )

    def run_findings(self) -> DataFrame:
        """Findings attributed to the run of their order."""
        return (
            self.view("findings").withColumn("linter", F.expr(_linter_of("review_id")))
            .withColumnRenamed("review_id", "repo_id")
        )


# SQL expressions that write one report of each tool from a line item row.
_N = "CAST(l_linenumber AS STRING)"
_C = "CAST(l_suppkey % 40 AS STRING)"
_F = "CAST(l_partkey % 8 AS STRING)"
_WORD = (
    "CASE l_returnflag WHEN 'R' THEN 'Error' WHEN 'A' THEN 'style' ELSE 'note' END"
)
PAYLOADS = {
    "eslint": (
        f"concat('[{{\"filePath\":\"/checkout/repo/src/m', {_F}, '.js\",\"messages\":[{{\"line\":', "
        f"{_N}, ',\"column\":', {_C}, ',\"severity\":', CASE l_returnflag WHEN 'R' THEN '2' WHEN 'A' "
        "THEN '1' ELSE '\"2\"' END, ',\"message\":\"used\",\"ruleId\":\"no-var\"},"
        "{\"severity\":2,\"message\":\"broken\",\"ruleId\":null}]},"
        "{\"filePath\":\"/checkout/repo/empty.js\",\"messages\":[]}]')"
    ),
    "flake8": (
        f"concat('./pkg/m', {_F}, '.py:', {_N}, ':', {_C}, ': E501 line too long', chr(10), "
        f"'  /checkout/repo/b.py:2:1: W', {_C}, ' blank  ', chr(10), 'c.py:1:1: SIM102 nested', "
        "chr(10))"
    ),
    "clippy": (
        f"concat('{{\"reason\":\"compiler-message\",\"message\":{{\"message\":\"unused\",\"level\":\"', "
        f"{_WORD}, '\",\"code\":{{\"code\":\"clippy::x\"}},\"spans\":[{{\"file_name\":\"src/a.rs\","
        f"\"line_start\":1,\"column_start\":1,\"is_primary\":false}},{{\"file_name\":\"src/m', {_F}, "
        f"'.rs\",\"line_start\":', {_N}, ',\"column_start\":', {_C}, ',\"is_primary\":true}}]}}}}', "
        "chr(10), '{\"reason\":\"build-finished\"}', chr(10), 'junk', chr(10), "
        "'{\"reason\":\"compiler-message\",\"message\":{\"message\":\"w\",\"level\":\"warning\","
        "\"code\":null,\"spans\":[{\"file_name\":\"src/z.rs\"}]}}')"
    ),
    "golangci-lint": (
        f"concat('{{\"Issues\":[{{\"FromLinter\":\"errcheck\",\"Text\":\"unchecked\",\"Pos\":"
        f"{{\"Filename\":\"pkg/m', {_F}, '.go\",\"Line\":', {_N}, ',\"Column\":', {_C}, '}}}},"
        "{\"Text\":\"x\",\"Pos\":{\"Filename\":\"\"}},{\"Pos\":{\"Filename\":\"pkg/z.go\"}}]}')"
    ),
    "checkstyle": (
        f"concat('<checkstyle><file name=\"/checkout/repo/src/M', {_F}, '.java\"><error line=\"', "
        f"{_N}, '\" column=\"', {_C}, '\" severity=\"', {_WORD}, '\" message=\"a &lt; b\" "
        "source=\"com.x.LineLength\"/><error line=\"0\" severity=\"warning\" message=\"use a/b\" "
        "source=\"com.x.Cut\"/></file><file name=\"B.java\"></file></checkstyle>')"
    ),
    "rubocop": (
        f"concat('{{\"files\":[{{\"path\":\"lib/m', {_F}, '.rb\",\"offenses\":[{{\"severity\":\"', "
        f"{_WORD}, '\",\"message\":\"long\",\"cop_name\":\"Layout/X\",\"location\":"
        f"{{\"start_line\":', {_N}, ',\"start_column\":', {_C}, '}}}},{{\"severity\":\"fatal\"}}]}},"
        "{\"path\":\"lib/none.rb\",\"offenses\":[]}]}')"
    ),
    "phpcs": (
        f"concat('{{\"files\":{{\"/checkout/repo/m', {_F}, '.php\":{{\"messages\":[{{\"line\":', {_N}, "
        f"',\"column\":', {_C}, ',\"type\":\"WARNING\",\"message\":\"tab\",\"source\":\"PSR12.X\"}},"
        "{\"type\":\"ERROR\"}]},\"n.php\":{\"messages\":[]}}}')"
    ),
    "cppcheck": (
        f"concat('<results><error id=\"nullPointer\" severity=\"', {_WORD}, '\" msg=\"p &amp;amp; q\">"
        f"<location file=\"/checkout/repo/m', {_F}, '.cpp\" line=\"', {_N}, '\" column=\"1\"/></error>"
        "<error id=\"noLoc\" severity=\"performance\" msg=\"slow\"/><error id=\"late\" "
        "severity=\"information\" msg=\"i\"><location file=\"z.h\" line=\"0\" col=\"7\"/></error>"
        "<error id=\"lost\" severity=\"error\" msg=\"gone\"/></results>')"
    ),
    "swiftlint": (
        f"concat('[{{\"file\":\"/checkout/repo/M', {_F}, '.swift\",\"line\":', {_N}, ',\"character\":', "
        f"{_C}, ',\"severity\":\"', {_WORD}, '\",\"reason\":\"r\",\"rule_id\":\"todo\"}},"
        "{\"file\":\"\"},{\"file\":\"Z.swift\",\"character\":null}]')"
    ),
    "ktlint": (
        f"concat('[{{\"file\":\"src/M', {_F}, '.kt\",\"errors\":[{{\"line\":', {_N}, ',\"col\":', {_C}, "
        "',\"message\":\"indent\",\"rule\":\"indent\"},{}]},{\"file\":\"E.kt\",\"errors\":[]}]')"
    ),
    "shellcheck": (
        f"concat('[{{\"file\":\"bin/m', {_F}, '.sh\",\"line\":', {_N}, ',\"column\":', {_C}, "
        f"',\"level\":\"', {_WORD}, '\",\"code\":2086,\"message\":\"quote\"}},{{\"file\":\"z.sh\"}}]')"
    ),
    "sqlfluff": (
        f"concat('[{{\"filepath\":\"db/m', {_F}, '.sql\",\"violations\":[{{\"line_no\":', {_N}, "
        f"',\"line_pos\":', {_C}, ',\"code\":\"L001\",\"description\":\"space\"}},{{}}]}}]')"
    ),
}
