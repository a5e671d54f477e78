"""Content-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.operators import scan
from reviewloom.sources.samples import Samples

_TEXT_RULES = (
    scan.Rule(r"[A-Z][a-z]+\.", "text/sentence-end", "info", "capitalised word before a dot"),
    scan.Rule(r"[#*$%&]{3}", "text/junk", "warning", "junk characters"),
    scan.Rule(r"[0-9]{4,}", "text/long-number", "error", "long number"),
)


def line_explode(spark, sf_dir):
    lines = scan.explode_lines(Samples(spark, sf_dir).view("files"))
    return lines.select("repo_id", "path", "line_no", F.length("text").cast("int").alias("chars"))


def text_rule_scan(spark, sf_dir):
    """Caller-supplied rules over the documents as they are."""
    found = scan.scan_rules(scan.explode_lines(Samples(spark, sf_dir).view("files")), _TEXT_RULES)
    return found.select("repo_id", "path", "line_no", "column", "rule_id", "severity")


def rule_scan(spark, sf_dir):
    files = scan.database_files(Samples(spark, sf_dir).view("code_files"))
    found = scan.scan_rules(scan.explode_lines(files))
    return found.select("repo_id", "path", "line_no", "column", "rule_id", "severity")


def lookahead_scan(spark, sf_dir):
    files = scan.database_files(Samples(spark, sf_dir).view("code_files"))
    return scan.scan_lookahead(files).select("repo_id", "path", "line_no", "column", "rule_id")


def database_findings(spark, sf_dir):
    found = scan.analyze_database_usage(Samples(spark, sf_dir).view("code_files"))
    return found.groupBy("repo_id", "rule_id", "severity", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("line").cast("bigint")).alias("lines")
    )


def secret_scan(spark, sf_dir):
    return scan.scan_secrets(Samples(spark, sf_dir).view("secret_files"))


def secret_stats(spark, sf_dir):
    files = Samples(spark, sf_dir).view("secret_files")
    return scan.secret_scan_stats(files, scan.scan_secrets(files))


def secret_gate(spark, sf_dir):
    return scan.secret_gate(scan.scan_secrets(Samples(spark, sf_dir).view("secret_files")))


def ungated_files(spark, sf_dir):
    files = Samples(spark, sf_dir).view("secret_files")
    gate = scan.secret_gate(scan.scan_secrets(files))
    return scan.without_blocked(files, gate).select("repo_id", "path")


def _lines(view: str, where: str = "true") -> str:
    return (
        f"n AS (SELECT repo_id, path, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM "
        f"(SELECT repo_id, path, string_split(content, chr(10)) AS ls FROM fx_{view} WHERE {where}) s)"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GATE = "regexp_matches(content, " + _quoted("|".join(f"(?:{p})" for p in scan.MONGO_IMPORTS)) + ")"
_LIVE = "NOT regexp_matches(t, '^\\s*(//|\\*|#)')"


def _rules(rules) -> str:
    return " UNION ALL ".join(
        f"SELECT repo_id, path, i, t, strpos(t, regexp_extract(t, {_quoted(r.pattern)})) AS c, "
        f"'{r.rule_id}' AS rule_id, '{r.severity}' AS severity FROM n "
        f"WHERE regexp_matches(t, {_quoted(r.pattern)}) AND {_LIVE}"
        for r in rules
    )


_WINDOW = "OVER (PARTITION BY repo_id, path ORDER BY i)"
_LEAN = (
    "b AS (SELECT *, concat_ws(chr(10), t, "
    + ", ".join(f"lead(t, {k}) {_WINDOW}" for k in range(1, 5))
    + ") AS block FROM n), "
    "lean AS (SELECT repo_id, path, i, strpos(t, '.find') AS c, 'mongodb/prefer-lean' AS rule_id, "
    "'info' AS severity FROM b WHERE regexp_matches(t, '\\b([A-Z][A-Za-z0-9]*)\\.(find(?:One)?)\\s*\\(') "
    f"AND {_LIVE} AND NOT regexp_matches(block, '\\.lean\\s*\\('))"
)
_SECRET_PATTERNS = (
    (r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "github_pat"),
    (r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", "github_pat_fine_grained"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "aws_access_key_id"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private_key"),
    (r"""\b(?i:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]""",
     "generic_api_key_assignment"),
)
#: A line ``t`` holds a secret.
SECRET_EXPRESSIONS = "(" + " OR ".join(f"regexp_matches(t, {_quoted(p)})" for p, _ in _SECRET_PATTERNS) + ")"
_LABELS = {rule.pattern_id: rule.label for rule in scan.SECRET_RULES}
_SKIPPED = "regexp_extract(path, '[^/]*$') IN ('README.md', '.env.example')"
_SECRETS = _lines("secret_files", f"NOT {_SKIPPED}") + ", s AS (" + " UNION ALL ".join(
    f"SELECT repo_id, path, CAST(i AS INT) AS line, '{name}' AS pattern_id, '{_LABELS[name]}' AS label, "
    f"concat(substr(m, 1, 6), '***REDACTED***') AS match_preview "
    f"FROM (SELECT repo_id, path, i, unnest(regexp_extract_all(t, {_quoted(p)})) AS m FROM n) u"
    for p, name in _SECRET_PATTERNS
) + (
    " UNION ALL SELECT repo_id, path, 1, 'env_file_committed', '.env file committed to repository', "
    "'.env***REDACTED***' FROM fx_secret_files WHERE regexp_extract(path, '[^/]*$') = '.env')"
)

QUERIES = {
    "line_explode": line_explode,
    "text_rule_scan": text_rule_scan,
    "rule_scan": rule_scan,
    "lookahead_scan": lookahead_scan,
    "database_findings": database_findings,
    "secret_scan": secret_scan,
    "secret_stats": secret_stats,
    "secret_gate": secret_gate,
    "ungated_files": ungated_files,
}

_SELECT = (
    "SELECT repo_id, path, CAST(i AS INT) AS line_no, CAST(c AS INT) AS \"column\", rule_id, severity FROM x"
)
ORACLES = {
    "line_explode": oracle(
        "SELECT repo_id, path, CAST(i AS INT) AS line_no, CAST(length(t) AS INT) AS chars FROM n",
        "files", ctes=_lines("files")),
    "text_rule_scan": oracle(
        _SELECT, "files", ctes=_lines("files") + f", x AS ({_rules(_TEXT_RULES)})"),
    "rule_scan": oracle(
        _SELECT, "code_files", ctes=_lines("code_files", _GATE) + f", x AS ({_rules(scan.MONGO_RULES)})"),
    "lookahead_scan": oracle(
        "SELECT repo_id, path, CAST(i AS INT) AS line_no, CAST(c AS INT) AS \"column\", rule_id FROM lean",
        "code_files", ctes=_lines("code_files", _GATE) + ", " + _LEAN),
    "database_findings": oracle(
        "SELECT repo_id, rule_id, severity, 'mongodb-analyzer' AS source, count(*) AS n, "
        "CAST(sum(i) AS BIGINT) AS lines FROM (SELECT repo_id, i, rule_id, severity FROM x UNION ALL "
        "SELECT repo_id, i, rule_id, severity FROM lean) u GROUP BY repo_id, rule_id, severity",
        "code_files",
        ctes=_lines("code_files", _GATE) + f", x AS ({_rules(scan.MONGO_RULES)}), " + _LEAN),
    "secret_scan": oracle("SELECT * FROM s", "secret_files", ctes=_SECRETS),
    "secret_stats": oracle(
        f"SELECT f.repo_id, count(*) FILTER (NOT {_SKIPPED}) AS scanned_files, "
        f"count(*) FILTER ({_SKIPPED}) AS skipped_files, (SELECT count(*) FROM s "
        "WHERE s.repo_id = f.repo_id) AS findings_count FROM fx_secret_files f GROUP BY f.repo_id",
        "secret_files", ctes=_SECRETS),
    "secret_gate": oracle(
        "SELECT repo_id, count(*) AS findings_count, 'SECRETS_FOUND' AS code, concat('Secret scan "
        "detected ', CAST(count(*) AS STRING), ' potential secret(s) in the repository. Review aborted "
        "to prevent leaking credentials to the AI provider.') AS message FROM s GROUP BY repo_id",
        "secret_files", ctes=_SECRETS),
    "ungated_files": oracle(
        "SELECT repo_id, path FROM fx_secret_files WHERE repo_id NOT IN (SELECT repo_id FROM s)",
        "secret_files", ctes=_SECRETS),
}
