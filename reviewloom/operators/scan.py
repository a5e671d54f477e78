"""Line-level scans of file content: pattern rules, the look-ahead rule and secrets.

All scans are narrow: a file's lines are exploded inside the task that read the file
and no content is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.paths import base_name
from reviewloom.functions.text import is_commented, redacted


@dataclass(frozen=True)
class Rule:
    """One pattern rule; ``pattern`` is a regular expression applied to single lines."""

    pattern: str
    rule_id: str
    severity: str
    message: str


@dataclass(frozen=True)
class SecretRule:
    pattern: str
    pattern_id: str
    label: str


ANALYZER = "mongodb-analyzer"

# The shipped database rules, in order.
MONGO_RULES = (
    Rule(r"\$where\s*:", "mongodb/no-where-operator", "error",
         "Avoid $where — it executes arbitrary JavaScript server-side and is a code injection "
         "risk. Use $expr instead."),
    Rule(r"\.find\(\s*\{\s*\}\s*[),]", "mongodb/no-empty-filter", "warning",
         ".find({}) fetches all documents. Add a query predicate, or use .limit() if you "
         "intentionally want all records."),
    Rule(r"\$regex\s*:", "mongodb/anchor-regex", "warning",
         "Unanchored $regex can cause a full collection scan. Prefix with ^ to use an index, or "
         "prefer $text search."),
    Rule(r"\.\s*drop\s*\(\s*\)", "mongodb/no-collection-drop", "error",
         "Collection .drop() detected. Ensure this is intentional and never reachable from live "
         "application code."),
    Rule(r"new\s+ObjectId\s*\(\s*\)", "mongodb/objectid-no-empty", "info",
         "new ObjectId() generates a fresh ID. If you want to wrap an existing string id, use "
         "new ObjectId(id)."),
    Rule(r"\.(updateMany|deleteMany)\s*\(\s*\{\s*\}", "mongodb/no-empty-bulk-filter", "error",
         "updateMany/deleteMany with an empty filter {} will modify ALL documents in the "
         "collection."),
)

# File gate and look-ahead rule of the database analyzer.
MONGO_EXTENSIONS = (".js", ".ts", ".mjs", ".cjs")
MONGO_IMPORTS = (
    r"require\s*\(\s*['\"]mongoose['\"]\s*\)",
    r"require\s*\(\s*['\"]mongodb['\"]\s*\)",
    r"from\s+['\"]mongoose['\"]",
    r"from\s+['\"]mongodb['\"]",
    r"import\s+mongoose",
)
LEAN_CALLER = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]*)\.(find(?:One)?)\s*\("
LEAN_CALL = r"\.lean\s*\("
LEAN_WINDOW = 5
PREFER_LEAN = Rule(
    LEAN_CALLER, "mongodb/prefer-lean", "info",
    "Consider .lean() on Mongoose read-only queries to return plain JS objects and reduce "
    "memory overhead.",
)

# Secret patterns follow the publicly documented token formats. Word edges are spelled out
# because the meaning of ``\b`` next to accented letters differs between Java releases.
_EDGE = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
SECRET_RULES = (
    SecretRule(_EDGE + r"gh[pousr]_[A-Za-z0-9]{36,}" + _END, "github_pat", "GitHub Personal Access Token"),
    SecretRule(_EDGE + r"github_pat_[A-Za-z0-9_]{22,}" + _END, "github_pat_fine_grained",
               "GitHub fine-grained token"),
    SecretRule(_EDGE + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _END, "aws_access_key_id", "AWS Access Key ID"),
    SecretRule(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private_key", "Private key block"),
    SecretRule(
        _EDGE + r"(?i:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}['\"]",
        "generic_api_key_assignment", "Generic API key assignment"),
)
ENV_FILE_ID = "env_file_committed"
ENV_FILE_LABEL = ".env file committed to repository"

# Files whose placeholder secrets are not findings.
SECRET_SKIPPED_FILES = ("README.md", ".env.example")


def explode_lines(files: DataFrame) -> DataFrame:
    """``repo_id, path, line_no, text``; a trailing empty line and carriage returns stay.

    The outer generators here keep Spark from adding a size filter below them, which
    would split (or match) every file twice.
    """
    lines = F.posexplode_outer(F.split("content", "\n", -1)).alias("line_no", "text")
    return files.select("repo_id", "path", lines).where(F.col("text").isNotNull()).withColumn(
        "line_no", F.col("line_no") + 1
    )


def _rule_hits(rules: Sequence[Rule], text: Column) -> Column:
    """Array of hits of one line: the first match of every rule."""
    hits = []
    for position, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        hits.append(
            F.when(
                text.rlike(rule.pattern),
                F.struct(
                    F.lit(position).alias("rule_no"),
                    F.regexp_instr(text, pattern).alias("column"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(rule.message).alias("message"),
                    F.lit(rule.rule_id).alias("rule_id"),
                ),
            )
        )
    return F.array_compact(F.array(*hits))


def scan_rules(lines: DataFrame, rules: Sequence[Rule] = MONGO_RULES) -> DataFrame:
    """First match of each rule per line, commented lines skipped.

    The rules are literals, so every pattern compiles once; a line is read once for all.
    """
    candidates = lines.where(F.col("text").rlike(_any_of(rules)) & ~is_commented(F.col("text")))
    return candidates.select(
        "repo_id", "path", "line_no", F.explode_outer(_rule_hits(rules, F.col("text"))).alias("h")
    ).where(F.col("h").isNotNull()).select("repo_id", "path", "line_no", "h.*")


def database_files(files: DataFrame) -> DataFrame:
    """Files whose content imports the database driver or mapper."""
    return files.where(F.col("content").rlike("|".join(f"(?:{p})" for p in MONGO_IMPORTS)))


def _line_windows(files: DataFrame, size: int) -> DataFrame:
    """Every line with the ``size`` - 1 lines after it, without a window or shuffle.

    The line array is zipped with copies of itself shifted by one, two, ... lines.
    """
    shifted = [F.col("__lines")] + [
        F.slice("__lines", F.lit(step + 1), F.size("__lines")) for step in range(1, size)
    ]
    zipped = F.arrays_zip(*[c.alias(f"l{i}") for i, c in enumerate(shifted)])
    return (
        files.withColumn("__lines", F.split("content", "\n", -1))
        .select("repo_id", "path", F.posexplode_outer(zipped).alias("line_no", "w"))
        .where(F.col("w").isNotNull())
        .withColumn("line_no", F.col("line_no") + 1)
    )


def scan_lookahead(
    files: DataFrame,
    caller: str = LEAN_CALLER,
    required: str = LEAN_CALL,
    size: int = LEAN_WINDOW,
    rule: Rule = PREFER_LEAN,
) -> DataFrame:
    """Lines matching ``caller`` without ``required`` on them or the next ``size`` - 1 lines."""
    windows = _line_windows(files, size)
    members = windows.schema["w"].dataType.names
    text = F.col("w")[members[0]]
    block = F.concat_ws("\n", *[F.col("w")[name] for name in members])
    return (
        windows.where(text.rlike(caller) & ~is_commented(text) & ~block.rlike(required))
        .select(
            "repo_id", "path", "line_no", F.lit(len(MONGO_RULES)).alias("rule_no"),
            F.instr(text, ".find").alias("column"), F.lit(rule.severity).alias("severity"),
            F.lit(rule.message).alias("message"), F.lit(rule.rule_id).alias("rule_id"),
        )
    )


def analyze_database_usage(files: DataFrame) -> DataFrame:
    """Findings of the built-in database analyzer in the common lint shape.

    ``files`` is already the walked listing with content. ``seq`` orders a file's findings
    by rule, then line.
    """
    gated = database_files(files)
    found = scan_rules(explode_lines(gated)).unionByName(scan_lookahead(gated))
    seq = F.col("rule_no").cast("bigint") * F.lit(2 ** 32) + F.col("line_no")
    return found.select(
        "repo_id", F.lit(ANALYZER).alias("linter"), F.col("path").alias("file"),
        seq.alias("seq"), F.col("line_no").alias("line"), "column", "severity", "message",
        "rule_id", F.lit(ANALYZER).alias("source"),
    )


def _is_skipped_for_secrets(path: Column) -> Column:
    return base_name(path).isin(*SECRET_SKIPPED_FILES)


def _any_of(rules: Sequence[Rule] | Sequence[SecretRule]) -> str:
    return "|".join(f"(?:{rule.pattern})" for rule in rules)


def _may_contain(files: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """Files that can hold a match, tested on whole content before lines are made.

    Skipped when a pattern could tell the start of a line from the start of the content.
    """
    bare = "".join(rule.pattern for rule in rules).replace(_EDGE, "").replace(_END, "")
    if any(token in bare for token in ("\\A", "\\z", "\\Z", "\\G", "(?<", "(?!", "(?=")):
        return files
    return files.where(F.col("content").rlike("(?m)" + _any_of(rules)))


def scan_secrets(files: DataFrame, rules: Sequence[SecretRule] = SECRET_RULES) -> DataFrame:
    """Redacted secret findings; a committed ``.env`` file is one by itself (line 1).

    Every match of a rule on a line is a finding; matches of one rule do not overlap.
    """
    scanned = files.where(~_is_skipped_for_secrets(F.col("path")))
    lines = explode_lines(_may_contain(scanned, rules)).where(F.col("text").rlike(_any_of(rules)))

    def hits_of(rule: SecretRule) -> Column:
        return F.transform(
            F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)),
            lambda match: F.struct(
                F.lit(rule.pattern_id).alias("pattern_id"), F.lit(rule.label).alias("label"),
                redacted(match).alias("match_preview"),
            ),
        )

    hits = F.flatten(F.array(*[hits_of(rule) for rule in rules]))
    matched = lines.select(
        "repo_id", "path", F.col("line_no").alias("line"), F.explode_outer(hits).alias("h")
    ).where(F.col("h").isNotNull()).select("repo_id", "path", "line", "h.*")
    env_files = scanned.where(base_name(F.col("path")) == ".env").select(
        "repo_id", "path", F.lit(1).alias("line"), F.lit(ENV_FILE_ID).alias("pattern_id"),
        F.lit(ENV_FILE_LABEL).alias("label"), redacted(F.lit(".env")).alias("match_preview"),
    )
    return matched.unionByName(env_files)


def secret_scan_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Scanned and skipped file counts and the number of findings per repository."""
    skipped = _is_skipped_for_secrets(F.col("path"))
    counts = files.groupBy("repo_id").agg(
        F.count_if(~skipped).alias("scanned_files"), F.count_if(skipped).alias("skipped_files")
    )
    found = findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return counts.join(found, "repo_id", "left").fillna(0, ["findings_count"])


# The text of an aborted review.
SECRETS_MESSAGE = (
    "Secret scan detected %d potential secret(s) in the repository. Review aborted "
    "to prevent leaking credentials to the AI provider."
)


def secret_gate(findings: DataFrame) -> DataFrame:
    """Repositories whose review is aborted, with the reason."""
    return (
        findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings_count"))
        .withColumn("code", F.lit("SECRETS_FOUND"))
        .withColumn(
            "message",
            F.format_string(SECRETS_MESSAGE, "findings_count"),
        )
    )


def without_blocked(table: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of repositories that pass the gate, joined on the keys of the blocked ones alone."""
    return table.join(gate.select("repo_id"), "repo_id", "left_anti")
