"""Lint-report and linter-run queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.operators import lint_reports, runs
from reviewloom.sources.samples import Samples


def _shown(found):
    return found.select(
        "repo_id", "file", "seq", "line", F.col("column").alias("col"), "severity", "message",
        "rule_id", "source",
    )


def lint_report(linter, spark, sf_dir):
    """Reports of one tool, one per line item."""
    return _shown(lint_reports.FORMATS[linter](Samples(spark, sf_dir).lint_reports(linter)))


def all_lint_reports(spark, sf_dir):
    """Reports of all twelve tools, one per line item, through the one normalisation job."""
    return _shown(lint_reports.normalize_lint_reports(Samples(spark, sf_dir).mixed_reports()))


def lint_report_malformed(spark, sf_dir):
    """The same reports with trailing text, a second value or single quotes: JSON tools give no rows."""
    mixed = Samples(spark, sf_dir).mixed_reports()
    broken = (
        F.when(F.col("repo_id").cast("bigint") % 3 == 0, F.concat("payload", F.lit(" trailing")))
        .when(F.col("repo_id").cast("bigint") % 3 == 1, F.concat("payload", F.lit(" "), "payload"))
        .otherwise(F.replace("payload", F.lit('"'), F.lit("'")))
    )
    whole = ("flake8", "checkstyle", "cppcheck")
    payload = F.when(F.col("linter").isin(*whole), F.col("payload")).otherwise(broken)
    return _shown(lint_reports.normalize_lint_reports(mixed.withColumn("payload", payload)))


def linter_runs(spark, sf_dir):
    s = Samples(spark, sf_dir)
    counted = runs.with_counts(runs.classify_runs(s.view("run_log")), s.run_findings())
    return counted.withColumn("status_text", runs.status_text())


def isolated_findings(spark, sf_dir):
    """Findings per linter once failed and skipped runs are taken out."""
    s = Samples(spark, sf_dir)
    good = runs.results_of_successful(s.run_findings(), runs.classify_runs(s.view("run_log")))
    return good.groupBy("linter").agg(F.count(F.lit(1)).alias("n"))


# Expected rows per tool: (file, seq, line, col, severity, message, rule), as SQL over lineitem.
_N, _C, _F = "l_linenumber", "CAST(l_suppkey % 40 AS INT)", "CAST(l_partkey % 8 AS STRING)"
_C1 = "CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE CAST(l_suppkey % 40 AS INT) END"
_SEV = "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END"
_NEXT = 2 ** 32
_EXPECTED = {
    "eslint": [
        (f"concat('src/m', {_F}, '.js')", 0, _N, _C, _SEV, "'used'", "'no-var'"),
        (f"concat('src/m', {_F}, '.js')", 1, 1, 1, "'error'", "'broken'", "'eslint/unknown'"),
    ],
    "flake8": [
        (f"concat('pkg/m', {_F}, '.py')", 0, _N, _C, "'warning'", "'line too long'", "'E501'"),
        ("'b.py'", 1, 2, 1, "'warning'", "'blank'", "concat('W', CAST(l_suppkey % 40 AS STRING))"),
    ],
    "clippy": [
        (f"concat('src/m', {_F}, '.rs')", 0, _N, _C, _SEV, "'unused'", "'clippy::x'"),
        ("'src/z.rs'", 3, 1, 1, "'warning'", "'w'", "'clippy/unknown'"),
    ],
    "golangci-lint": [
        (f"concat('pkg/m', {_F}, '.go')", 0, _N, _C, "'warning'", "'unchecked'",
         "'golangci-lint/errcheck'"),
        ("'pkg/z.go'", 2, 1, 1, "'warning'", "''", "'golangci-lint/unknown'"),
    ],
    "checkstyle": [
        (f"concat('src/M', {_F}, '.java')", _NEXT, _N, _C1, _SEV, "'a < b'", "'checkstyle/LineLength'"),
        (f"concat('src/M', {_F}, '.java')", _NEXT + 1, 1, 1, "'warning'", "''", "'checkstyle/unknown'"),
    ],
    "rubocop": [
        (f"concat('lib/m', {_F}, '.rb')", 0, _N, _C, _SEV, "'long'", "'Layout/X'"),
        (f"concat('lib/m', {_F}, '.rb')", 1, 1, 1, "'error'", "''", "'rubocop/unknown'"),
    ],
    "phpcs": [
        (f"concat('m', {_F}, '.php')", 0, _N, _C, "'warning'", "'tab'", "'PSR12.X'"),
        (f"concat('m', {_F}, '.php')", 1, 1, 1, "'error'", "''", "'phpcs/unknown'"),
    ],
    "cppcheck": [
        (f"concat('m', {_F}, '.cpp')", 0, _N, 1, _SEV, "'p &amp; q'", "'cppcheck/nullPointer'"),
        ("'z.h'", _NEXT, 1, 7, "'warning'", "'slow'", "'cppcheck/noLoc'"),
        ("'z.h'", _NEXT + 1, 1, 7, "'info'", "'i'", "'cppcheck/late'"),
    ],
    "swiftlint": [
        (f"concat('M', {_F}, '.swift')", 0, _N, _C, _SEV, "'r'", "'swiftlint/todo'"),
        ("'Z.swift'", 2, 1, 1, "'info'", "''", "'swiftlint/unknown'"),
    ],
    "ktlint": [
        (f"concat('src/M', {_F}, '.kt')", 0, _N, _C, "'warning'", "'indent'", "'ktlint/indent'"),
        (f"concat('src/M', {_F}, '.kt')", 1, 1, 1, "'warning'", "''", "'ktlint/unknown'"),
    ],
    "shellcheck": [
        (f"concat('bin/m', {_F}, '.sh')", 0, _N, _C, _SEV, "'quote'", "'shellcheck/SC2086'"),
        ("'z.sh'", 1, 1, 1, "'info'", "''", "'shellcheck/SC0'"),
    ],
    "sqlfluff": [
        (f"concat('db/m', {_F}, '.sql')", 0, _N, _C, "'warning'", "'space'", "'sqlfluff/L001'"),
        (f"concat('db/m', {_F}, '.sql')", 1, 1, 1, "'warning'", "''", "'sqlfluff/unknown'"),
    ],
}


def expected_rows(linter: str) -> list[tuple]:
    """Expected rows of one report of the tool (see ``_EXPECTED``)."""
    return _EXPECTED[linter]


def _expected(linter: str, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(l_orderkey AS STRING) AS repo_id, {file} AS file, CAST({seq} AS BIGINT) AS seq, "
        f"CAST({line} AS INT) AS line, CAST({col} AS INT) AS col, {severity} AS severity, "
        f"{message} AS message, {rule} AS rule_id, '{linter}' AS source FROM lineitem "
        f"WHERE l_partkey % 10 <> 0 AND {where}"
        for file, seq, line, col, severity, message, rule in _EXPECTED[linter]
    )


# With trailing text only the last line is broken; with the report twice, the line where both meet.
_CLIPPY_FIRST, _CLIPPY_LAST = _EXPECTED["clippy"]
_CLIPPY_LEFT = " UNION ALL ".join(
    f"SELECT CAST(l_orderkey AS STRING) AS repo_id, {file} AS file, CAST({seq} AS BIGINT) AS seq, "
    f"CAST({line} AS INT) AS line, CAST({col} AS INT) AS col, {severity} AS severity, {message} AS message, "
    f"{rule} AS rule_id, 'clippy' AS source FROM lineitem WHERE l_partkey % 10 <> 0 AND "
    f"(l_orderkey + l_linenumber) % 12 = 2 AND {where}"
    for (file, _, line, col, severity, message, rule), seq, where in (
        (_CLIPPY_FIRST, 0, "l_orderkey % 3 < 2"), (_CLIPPY_LAST, 6, "l_orderkey % 3 = 1"))
)

_STATUS = (
    "s AS (SELECT *, CASE WHEN NOT ran THEN 'skipped' WHEN repo_id % 7 < 4 THEN 'failed' ELSE 'success' END "
    "AS status, CASE WHEN ran AND repo_id % 7 < 4 THEN CASE repo_id % 7 WHEN 0 THEN 'binary_not_found' "
    "WHEN 3 THEN 'runtime_error' ELSE 'parse_error' END END AS reason FROM fx_run_log)"
)

QUERIES = {
    **{f"lint_report_{name.replace('-', '_')}": partial(lint_report, name) for name in _EXPECTED},
    "all_lint_reports": all_lint_reports,
    "lint_report_malformed": lint_report_malformed,
    "linter_runs": linter_runs,
    "isolated_findings": isolated_findings,
}

ORACLES = {
    **{f"lint_report_{name.replace('-', '_')}": _expected(name) for name in _EXPECTED},
    "all_lint_reports": " UNION ALL ".join(
        _expected(name, f"(l_orderkey + l_linenumber) % 12 = {k}") for k, name in enumerate(_EXPECTED)
    ),
    # A broken line of the line-wise JSON tool leaves its other lines, so it has rows of its own.
    "lint_report_malformed": " UNION ALL ".join(
        [
            _expected(name, f"(l_orderkey + l_linenumber) % 12 = {k}")
            for k, name in enumerate(_EXPECTED) if name in ("flake8", "checkstyle", "cppcheck")
        ] + [_CLIPPY_LEFT]
    ),
    "linter_runs": oracle(
        "SELECT *, CASE status WHEN 'success' THEN CASE issue_count WHEN 0 THEN 'Clean' WHEN 1 THEN "
        "'1 issue' ELSE concat(CAST(issue_count AS STRING), ' issues') END WHEN 'failed' THEN CASE WHEN "
        "reason = 'binary_not_found' THEN 'Not installed on this server' ELSE 'Did not run' END ELSE "
        "'Skipped — no matching files' END AS status_text FROM (SELECT repo_id, linter, status, CASE WHEN "
        "reason = 'binary_not_found' THEN concat(linter, ' binary not found. Install it on the server to "
        "enable ', linter, ' linting.') WHEN status = 'failed' THEN error_message END AS error, reason, "
        "coalesce(n, 0) AS issue_count, coalesce(k, 0) AS files_with_issues FROM s LEFT JOIN (SELECT "
        "review_id, count(*) AS n, count(DISTINCT file) AS k FROM fx_findings GROUP BY review_id) c "
        "ON c.review_id = s.repo_id) t", "run_log", "findings", ctes=_STATUS),
    "isolated_findings": oracle(
        "SELECT linter, count(*) AS n FROM fx_findings f JOIN s ON s.repo_id = f.review_id "
        "WHERE status = 'success' GROUP BY linter", "run_log", "findings", ctes=_STATUS),
}

