"""Prompt, fix and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import ISSUE_KEY, RANK, WEIGHT, oracle
from reviewloom.operators import eligibility, findings as fnd, merge, runs
from reviewloom.plans import fixes, prompts, review
from reviewloom.sources import tables
from reviewloom.sources.samples import Samples

_URL = "concat('https://github.com/o/r', CAST(repo_id AS STRING))"
_LANGUAGES = (
    "CASE review_id % 3 WHEN 0 THEN array(struct(11 AS registry_pos, 'sql' AS language), "
    "struct(0 AS registry_pos, 'javascript' AS language)) "
    "WHEN 1 THEN array(struct(1 AS registry_pos, 'python' AS language)) END"
)


def _reviews(s: Samples):
    """Reviews with URL, metadata warnings of their repository and a notice now and then."""
    warned = s.view("metadata").select("repo_id", eligibility.metadata_warnings().alias("warnings"))
    return s.reviews().join(warned, "repo_id").withColumn("repo_url", F.expr(_URL)).withColumn(
        "notices", F.expr("CASE WHEN review_id % 5 = 0 THEN array('2 files skipped') END")
    )


def _languages(s: Samples):
    return s.table("orders").selectExpr("o_orderkey AS review_id").select(
        "review_id", F.explode(F.expr(_LANGUAGES)).alias("l")
    ).select("review_id", "l.*")


def _runs(s: Samples):
    counted = runs.with_counts(runs.classify_runs(s.view("run_log")), s.run_findings())
    return counted.withColumnRenamed("repo_id", "review_id").withColumn("registry_pos", F.lit(0))


def _contents(s: Samples):
    """The files every repository's findings name, row by row from customers."""
    return s.table("customer").select(
        F.col("c_custkey").alias("repo_id"), F.col("c_name"),
        F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k"),
    ).selectExpr(
        "repo_id", "concat('src/m', CAST(k AS STRING), '.js') AS path",
        "concat('// ', c_name, chr(10), 'f(', CAST(k AS STRING), ')') AS content",
    )


def prompt_full(spark, sf_dir):
    s = Samples(spark, sf_dir)
    return prompts.full_prompts(
        _reviews(s), s.lint_findings(), _runs(s), _languages(s), issues=3, files=2
    )


def prompt_incremental(spark, sf_dir):
    s = Samples(spark, sf_dir)
    reviews = _reviews(s).where(F.col("mode") == "incremental")
    built = prompts.incremental_prompts(reviews, s.changes(), s.lint_findings())
    return built.select("review_id", "section", "file_order", "file", "part", "text")


def prompt_incremental_parts(spark, sf_dir):
    """Totals of the parts of each section."""
    s = Samples(spark, sf_dir)
    reviews = _reviews(s).where(F.col("mode") == "incremental")
    parts = prompts.incremental_prompts(reviews, s.changes(), s.lint_findings())
    return parts.groupBy("section").agg(
        F.sum(F.length("text").cast("bigint")).alias("chars"), F.count(F.lit(1)).alias("parts")
    )


_BYTES = 512


def prompt_incremental_bytes(spark, sf_dir):
    """Whole diff prompts in parts of at most 512 bytes, most diffs and lists cut somewhere."""
    s = Samples(spark, sf_dir)
    reviews = _reviews(s).where(F.col("mode") == "incremental")
    return prompts.incremental_prompt_parts(reviews, s.changes(), s.lint_findings(), _BYTES)


def prompt_fix(spark, sf_dir):
    s = Samples(spark, sf_dir)
    reviews = s.reviews().withColumn("repo_url", F.expr(_URL))
    return prompts.fix_prompts(
        reviews.select("review_id", "repo_id", "repo_url"), s.issues(), _contents(s), 4, 2
    )


def _candidates(s: Samples):
    reviews = s.reviews().selectExpr(
        "review_id", "repo_id", "score", "head_sha", "branch AS base_branch",
        f"{_URL} AS repo_url", "1700000000000 + review_id AS epoch_ms", "review_id % 4 <> 0 AS has_token",
    )
    return fixes.fix_candidates(reviews, s.issues())


def fix_outcome(spark, sf_dir):
    s = Samples(spark, sf_dir)
    return fixes.fix_outcomes(_candidates(s), s.view("fix_responses"))


def pr_payload(spark, sf_dir):
    s = Samples(spark, sf_dir)
    return fixes.fix_plan(_candidates(s), s.view("fix_responses"))


def fix_prompt_plan(spark, sf_dir):
    """Prompts of the reviews that are bad enough and may be written to."""
    s = Samples(spark, sf_dir)
    built = fixes.fix_requests(_candidates(s), s.issues(), _contents(s))
    return built.select("review_id", F.length("prompt").cast("int").alias("chars"))


def _reports(s: Samples):
    reviews = _reviews(s).withColumn("default_branch", F.col("branch")).withColumn(
        "base_sha", F.lit(None).cast("string")
    )
    answers = s.table("orders").selectExpr(
        "o_orderkey AS review_id", "'primary' AS provider_used",
        "concat('{\"summary\":\"S', CAST(o_orderkey AS STRING), '\",\"score\":', "
        "CAST(o_orderkey % 101 AS STRING), ',\"issues\":[]}') AS text",
    )
    lint = merge.in_changed_files(s.lint_findings(), s.changes(), ["review_id"])
    outcomes = fixes.fix_outcomes(_candidates(s), s.view("fix_responses"))
    return review.assemble_reports(
        reviews, answers, s.issues(), fnd.total_findings(lint, "review_id"), _runs(s), _languages(s),
        s.changes(), outcomes, "2026-01-01T00:00:00Z",
    )


def report_assembly(spark, sf_dir):
    rows = _reports(Samples(spark, sf_dir))
    return rows.select(
        "review_id", "repo_id", "repo_url", "mode", "default_branch", "provider_used", "summary",
        "score", "issue_count", "changed_file_count", "lint_issues_found", "pr_ready", "pr_reason",
        F.array_join("languages", ",").alias("languages"),
        F.array_join(F.transform("linter_runs", lambda r: F.concat_ws(
            ":", r["linter"], r["status"], r["issue_count"].cast("string"))), ",").alias("linter_runs"),
        F.size("validation_warnings").alias("warnings"),
    )


def persisted_review(spark, sf_dir):
    s = Samples(spark, sf_dir)
    scores = s.view("requests").selectExpr("repo_id", "CAST(repo_id % 50 AS INT) AS previous_score")
    rows = review.persisted_reviews(_reports(s).withColumn(
        "score", F.when(F.col("review_id") % 2 == 0, F.col("score"))), scores)
    return rows.select("review_id", "repo_id", "mode", "branch", "score", "summary", "pr_created")


def report_export(spark, sf_dir):
    """Issue lists as nested JSON documents in bounded parts."""
    rows = tables.issue_json(Samples(spark, sf_dir).issues(), rows_per_part=10 ** 12)
    return rows.select("review_id", "part", F.expr("json_array_length(get_json_object(json, '$.issues'))")
                       .alias("issues"))


def _merged(s: Samples):
    """Two requests per repository, answered alike, merged into its stored issues."""
    both = s.table("customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    latest = both.selectExpr(
        "c_custkey AS repo_id", "c_custkey * 2 + k AS review_id",
        "CASE (c_custkey + k) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' ELSE 'unchanged' END AS mode",
    )
    answers = both.selectExpr(
        "c_custkey AS repo_id", "c_custkey * 2 + k AS review_id",
        "concat('{\"issues\":[{\"file\":\"src/m1.js\",\"message\":\"new\",\"severity\":\"error\"},"
        "{\"file\":\"src/m1.js\",\"message\":\"new\",\"severity\":\"error\"}]}') AS text",
    )
    rounds = s.reviews().groupBy("repo_id").agg(F.max("review_id").alias("review_id"))
    previous = s.issues().join(rounds, "review_id")
    # The second request of a repository finds no changes.
    changes = s.changes().join(rounds, "review_id").withColumn("review_id", F.col("repo_id") * 2)
    return review.merged_issues(answers, latest, previous, changes)


def merged_reviews(spark, sf_dir):
    """Issues of each merged list by origin."""
    return _merged(Samples(spark, sf_dir)).groupBy("review_id", "origin").agg(F.count(F.lit(1)).alias("n"))


def merged_issue_list(spark, sf_dir):
    """The merged lists in their order."""
    return _merged(Samples(spark, sf_dir)).select(
        "repo_id", "review_id", "list_pos", "origin", "seq", "file", "line", "category", "message")


def merged_export(spark, sf_dir):
    """The merged lists as whole JSON documents."""
    rows = tables.issue_json(_merged(Samples(spark, sf_dir)).select(
        "review_id", "list_pos", "file", "message"), rows_per_part=4)
    return rows.select("review_id", F.col("part").cast("bigint").alias("part"), "json")


def _agg(text: str, order: str) -> str:
    return f"string_agg({text}, chr(10) ORDER BY {order})"


_SEV = "'[' || upper(severity) || ']'"
_LINE = "coalesce(CAST(line AS STRING), '?')"
_MB = (
    "CAST(CAST(floor(size_kb * 10 / 1024.0 + 0.5) AS BIGINT) // 10 AS STRING) || '.' || "
    "CAST(CAST(floor(size_kb * 10 / 1024.0 + 0.5) AS BIGINT) % 10 AS STRING)"
)
_WARNED = (
    "wm AS (SELECT repo_id, CASE WHEN archived THEN '- [REPO_ARCHIVED] Repository is archived. Review "
    "results may be outdated.' || chr(10) ELSE '' END || CASE WHEN size_kb > 512000 THEN '- [REPO_LARGE] "
    f"Repository size is approximately ' || {_MB} || ' MB (GitHub metadata). Large repos may be slow to "
    "process.' || chr(10) ELSE '' END || CASE WHEN disabled THEN '- [REPO_DISABLED] Repository is disabled "
    "on GitHub.' || chr(10) ELSE '' END || CASE WHEN fork THEN '- [REPO_FORK] Repository is a fork. Consider "
    "reviewing the upstream source of truth.' || chr(10) ELSE '' END AS warned, CAST(archived AS INT) + "
    "CAST(size_kb > 512000 AS INT) + CAST(disabled AS INT) + CAST(fork AS INT) AS nw FROM fx_metadata)"
)
_RUNS = (
    "rs AS (SELECT repo_id AS review_id, linter, error_message, CASE WHEN NOT ran THEN 'skipped' WHEN "
    "repo_id % 7 < 4 THEN 'failed' ELSE 'success' END AS status, (SELECT count(*) FROM fx_findings f WHERE "
    "f.review_id = repo_id) AS n, (SELECT count(DISTINCT file) FROM fx_findings f WHERE f.review_id = "
    "repo_id) AS k FROM fx_run_log)"
)
_FULL = (
    _WARNED + ", " + _RUNS + ", "
    "o AS (SELECT review_id, file, min(seq) AS file_order FROM fx_findings GROUP BY review_id, file), "
    f"r AS (SELECT f.*, row_number() OVER (PARTITION BY f.review_id ORDER BY {RANK}, o.file_order, f.file, "
    "f.seq) AS rank FROM fx_findings f JOIN o ON o.review_id = f.review_id AND o.file = f.file), "
    "g AS (SELECT *, dense_rank() OVER (PARTITION BY review_id ORDER BY first_rank) AS file_rank FROM "
    "(SELECT *, min(rank) OVER (PARTITION BY review_id, file) AS first_rank FROM r WHERE rank <= 3) a), "
    "h AS (SELECT review_id, file_rank, chr(10) || '### ' || file || chr(10) || "
    + _agg(f"'  ' || {_SEV} || ' L' || {_LINE} || ' [' || rule_id || '] ' || message", "rank")
    + " AS block FROM g WHERE file_rank <= 2 GROUP BY review_id, file_rank, file), "
    f"b AS (SELECT review_id, {_agg('block', 'file_rank')} AS blocks FROM h GROUP BY review_id), "
    "t AS (SELECT review_id, count(*) AS total FROM fx_findings GROUP BY review_id)"
)
_URL_V = "'https://github.com/o/r' || CAST(v.repo_id AS STRING)"
_LANG_TEXT = "CASE v.review_id % 3 WHEN 0 THEN 'javascript, sql' WHEN 1 THEN 'python' ELSE 'unknown' END"
_NO_PATCH = (
    "'(no patch available — file is binary, or the diff is too large to inline; skip detailed review of "
    "this file)'"
)
_UNITS = (
    "v AS (SELECT * FROM fx_reviews WHERE mode = 'incremental'), "
    "l AS (SELECT f.*, min(f.seq) OVER (PARTITION BY f.review_id, f.file) AS fo FROM fx_findings f "
    "JOIN v ON v.review_id = f.review_id JOIN fx_changes c ON c.review_id = f.review_id AND "
    "c.filename = f.file), "
    f"u AS (SELECT v.review_id, 0 AS s, 0 AS a, 0 AS b, '## Repository: ' || {_URL_V} || chr(10) || "
    "'## Files changed in this diff: ' || CAST((SELECT count(*) FROM fx_changes c WHERE c.review_id = "
    "v.review_id) AS STRING) || chr(10) || chr(10) || '## Diff' AS t, '' AS file FROM v UNION ALL "
    "SELECT c.review_id, 1, 0, file_no, chr(10) || '### ' || filename || ' (' || status || ')' || "
    "coalesce(chr(10) || 'renamed from: ' || previous_filename, '') || chr(10) || "
    f"coalesce('```diff' || chr(10) || patch || chr(10) || '```', {_NO_PATCH}), '' FROM fx_changes c "
    "JOIN v ON v.review_id = c.review_id UNION ALL "
    "SELECT DISTINCT review_id, 2, -1, 0, chr(10) || '## Lint findings for changed files', '' FROM l UNION ALL "
    f"SELECT review_id, 2, fo, seq, '  ' || {_SEV} || ' ' || file || ':L' || {_LINE} || ' [' || rule_id || "
    "'] ' || message, file FROM l UNION ALL SELECT review_id, 3, 0, 0, chr(10) || '---' || chr(10) || "
    "'Review only the diff above and produce the structured JSON review report.', '' FROM v)"
)
def _fix_ctes(issues: int, files: int) -> str:
    return _FIX.replace("{issues}", str(issues)).replace("{files}", str(files))


_FIX = (
    f"r AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {RANK}, seq) AS rank "
    "FROM fx_findings), top AS (SELECT * FROM r WHERE rank <= {issues}), "
    "ff AS (SELECT review_id, file, row_number() OVER (PARTITION BY review_id ORDER BY min(rank)) AS fr "
    "FROM top GROUP BY review_id, file), "
    "fl AS (SELECT c_custkey AS repo_id, k, 'src/m' || CAST(k AS STRING) || '.js' AS path, '// ' || c_name "
    "|| chr(10) || 'f(' || CAST(k AS STRING) || ')' AS content FROM customer, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) "
    "AS k) ks), "
    "bl AS (SELECT review_id, count(*) AS n, "
    + _agg(f"'- ' || {_SEV} || ' ' || file || ':' || {_LINE} || ' — ' || message || CASE WHEN suggestion "
           "<> '' THEN chr(10) || '  suggestion: ' || suggestion ELSE '' END", "rank")
    + " AS bullets FROM top GROUP BY review_id), "
    "ct AS (SELECT ff.review_id, "
    + _agg("chr(10) || '### ' || ff.file || chr(10) || '```' || chr(10) || content || chr(10) || '```'", "fr")
    + " AS contents FROM ff JOIN fx_reviews v ON v.review_id = ff.review_id JOIN fl ON fl.repo_id = v.repo_id "
    "AND fl.path = ff.file WHERE fr <= {files} GROUP BY ff.review_id)"
)
_FIX_TEXT = (
    f"'## Repository: ' || {_URL_V} || chr(10) || chr(10) || '## Issues to fix (' || "
    "CAST(coalesce(n, 0) AS STRING) || ')' || chr(10) || coalesce(bullets || chr(10), '') || chr(10) || "
    "'## Current file contents' || chr(10) || coalesce(contents || chr(10), '') || chr(10) || '---' || "
    "chr(10) || 'Produce the JSON response now.'"
)
_FIX_FROM = (
    "FROM fx_reviews v LEFT JOIN bl ON bl.review_id = v.review_id "
    "LEFT JOIN ct ON ct.review_id = v.review_id"
)
_DECIDE = (
    f"w AS (SELECT review_id, sum({WEIGHT}) AS weighted, bool_or(severity IN ('error', 'warning')) AS act "
    "FROM fx_findings GROUP BY review_id), "
    "dc AS (SELECT v.*, v.review_id % 4 <> 0 AS token, CASE WHEN score IS NULL OR NOT coalesce(act, false) "
    "THEN false ELSE score < 60 OR weighted >= 8 END AS opens, CASE WHEN NOT coalesce(act, false) THEN 'no "
    "error/warning-level issues found' WHEN score IS NULL THEN 'no score' WHEN score < 60 THEN concat('health "
    "score ', CAST(score AS STRING), ' is below threshold 60') WHEN weighted >= 8 THEN concat('weighted issue "
    "score ', CAST(weighted AS STRING), ' is at/above threshold 8') ELSE 'issues present but under both "
    "thresholds' END AS reason FROM fx_reviews v LEFT JOIN w ON w.review_id = v.review_id), "
    "oc AS (SELECT review_id, opens AND token AND review_id % 5 < 2 AS ready, CASE WHEN NOT opens THEN "
    "reason WHEN NOT token THEN 'no githubToken with write access provided' WHEN review_id % 5 >= 2 THEN "
    "'AI did not return any safe fixes' ELSE reason END AS outcome FROM dc)"
)
_REPORT = (
    _WARNED + ", " + _RUNS + ", " + _DECIDE + ", "
    "rp AS (SELECT v.*, (SELECT count(*) FROM fx_findings f WHERE f.review_id = v.review_id) AS issue_count, "
    "(SELECT count(*) FROM fx_changes c WHERE c.review_id = v.review_id) AS changed_file_count, "
    "(SELECT count(*) FROM fx_findings f JOIN fx_changes c ON c.review_id = f.review_id AND c.filename = "
    "f.file WHERE f.review_id = v.review_id) AS lint_issues_found FROM fx_reviews v)"
)

_MERGED = (
    "m AS (SELECT repo_id, max(review_id) AS review_id FROM fx_reviews GROUP BY repo_id), "
    "q AS (SELECT c_custkey AS repo_id, c_custkey * 2 + k AS review_id, (c_custkey + k) % 3 AS mode, k "
    "FROM customer, (SELECT unnest([0, 1]) AS k) ks), "
    "p AS (SELECT f.*, q.repo_id, q.review_id AS request, q.mode, q.k FROM fx_findings f "
    "JOIN m ON m.review_id = f.review_id JOIN q ON q.repo_id = m.repo_id), "
    "d AS (SELECT m.repo_id, coalesce(previous_filename, filename) AS file FROM fx_changes c JOIN m "
    "ON m.review_id = c.review_id WHERE status <> 'added' UNION SELECT m.repo_id, filename FROM "
    "fx_changes c JOIN m ON m.review_id = c.review_id WHERE status = 'removed'), "
    "n AS (SELECT repo_id, review_id, mode, unnest([0, 1]) AS seq FROM q WHERE mode < 2), "
    "a AS (SELECT repo_id, request AS review_id, mode, 0 AS origin, seq, file, line, category, message FROM p "
    "WHERE mode = 2 OR mode = 1 AND (k = 1 OR NOT EXISTS (SELECT 1 FROM d WHERE d.repo_id = p.repo_id AND "
    "d.file = p.file)) UNION ALL SELECT repo_id, review_id, mode, 1, seq, 'src/m1.js', CAST(NULL AS INT), 'lint', "
    "'new' FROM n), "
    f"y AS (SELECT *, row_number() OVER (PARTITION BY review_id, {ISSUE_KEY} ORDER BY origin, seq) AS rn FROM a), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY origin, seq) AS list_pos FROM y "
    "WHERE mode <> 1 OR rn = 1)"
)

QUERIES = {
    "prompt_full": prompt_full,
    "prompt_incremental": prompt_incremental,
    "prompt_incremental_parts": prompt_incremental_parts,
    "prompt_incremental_bytes": prompt_incremental_bytes,
    "prompt_fix": prompt_fix,
    "fix_outcome": fix_outcome,
    "pr_payload": pr_payload,
    "fix_prompt_plan": fix_prompt_plan,
    "report_assembly": report_assembly,
    "persisted_review": persisted_review,
    "report_export": report_export,
    "merged_reviews": merged_reviews,
    "merged_issue_list": merged_issue_list,
    "merged_export": merged_export,
}

ORACLES = {
    "prompt_full": oracle(
        f"SELECT v.review_id, '## Repository: ' || {_URL_V} || chr(10) || '## Detected Languages: ' || "
        f"{_LANG_TEXT} || chr(10) || chr(10) || CASE WHEN nw > 0 THEN '## Repository Metadata Warnings' || "
        "chr(10) || warned || chr(10) ELSE '' END || CASE WHEN v.review_id % 5 = 0 THEN '## Secret Scan "
        "Notices' || chr(10) || '- 2 files skipped' || chr(10) || chr(10) ELSE '' END || '## Linter Run "
        "Summary' || chr(10) || CASE rs.status WHEN 'success' THEN '- ' || linter || ': ✓ ' || CAST(k AS "
        "STRING) || ' files with issues' || chr(10) WHEN 'failed' THEN '- ' || linter || ': ✗ ' || CASE "
        "v.review_id % 7 WHEN 0 THEN 'not installed' ELSE error_message END || chr(10) ELSE '' END || "
        "chr(10) || '## Lint Findings (showing ' || CAST(least(3, coalesce(total, 0)) AS STRING) || ' of ' "
        "|| CAST(coalesce(total, 0) AS STRING) || ' total)' || chr(10) || coalesce(blocks, 'No lint issues "
        "found.') || chr(10) || chr(10) || '---' || chr(10) || 'Analyze the above findings and produce a "
        "structured JSON review report.' AS prompt FROM fx_reviews v JOIN wm ON wm.repo_id = v.repo_id "
        "JOIN rs ON rs.review_id = v.review_id LEFT JOIN b ON b.review_id = v.review_id "
        "LEFT JOIN t ON t.review_id = v.review_id",
        "reviews", "findings", "metadata", "run_log", ctes=_FULL),
    "prompt_incremental": oracle(
        "SELECT review_id, s AS section, CAST(a AS BIGINT) AS file_order, file, "
        f"CAST(b // {prompts.ROWS_PER_PART} AS BIGINT) AS part, {_agg('t', 'b')} AS text FROM u "
        f"GROUP BY review_id, s, a, file, b // {prompts.ROWS_PER_PART}",
        "reviews", "changes", "findings", ctes=_UNITS),
    "prompt_incremental_parts": oracle(
        "SELECT s AS section, CAST(sum(c) AS BIGINT) AS chars, count(*) AS parts FROM (SELECT review_id, s, "
        f"a, b // {prompts.ROWS_PER_PART} AS p, sum(length(t)) + count(*) - 1 AS c FROM u GROUP BY ALL) x GROUP BY s",
        "reviews", "changes", "findings", ctes=_UNITS),
    "prompt_incremental_bytes": oracle(
        f"SELECT review_id, CAST(start // {_BYTES // 2} AS BIGINT) AS part, "
        "string_agg(piece, '' ORDER BY s, a, file, b, i) AS text FROM (SELECT *, "
        "coalesce(sum(strlen(piece)) OVER (PARTITION BY review_id ORDER BY s, a, file, b, i "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT review_id, s, a, file, "
        f"b, i, substr(t, CAST(i * {_BYTES // 8} + 1 AS BIGINT), {_BYTES // 8}) AS piece FROM (SELECT *, "
        f"unnest(range((length(t) + {_BYTES // 8} - 1) // {_BYTES // 8})) AS i FROM (SELECT review_id, s, a, "
        "file, b, CASE WHEN s > 0 THEN chr(10) ELSE '' END || t AS t FROM u) x0) x1) x2) x3 "
        f"GROUP BY review_id, start // {_BYTES // 2}",
        "reviews", "changes", "findings", ctes=_UNITS),
    "prompt_fix": oracle(
        f"SELECT v.review_id, {_FIX_TEXT} AS prompt {_FIX_FROM}", "reviews", "findings",
        ctes=_fix_ctes(4, 2)),
    "fix_prompt_plan": oracle(
        f"SELECT v.review_id, CAST(length({_FIX_TEXT}) AS INT) AS chars {_FIX_FROM} JOIN dc ON "
        "dc.review_id = v.review_id WHERE opens AND token", "reviews", "findings",
        ctes=_fix_ctes(10, 6) + ", " + _DECIDE),
    "merged_reviews": oracle(
        "SELECT review_id, origin, count(*) AS n FROM z GROUP BY review_id, origin",
        "reviews", "findings", "changes", ctes=_MERGED),
    "merged_issue_list": oracle(
        "SELECT repo_id, review_id, list_pos, origin, seq, file, line, category, message FROM z",
        "reviews", "findings", "changes", ctes=_MERGED),
    "merged_export": oracle(
        "SELECT review_id, list_pos // 4 AS part, '{\"review_id\":' || CAST(review_id AS STRING) || "
        "',\"part\":' || CAST(list_pos // 4 AS STRING) || ',\"issues\":[' || string_agg('{\"list_pos\":' || "
        "CAST(list_pos AS STRING) || ',\"file\":\"' || file || '\",\"message\":\"' || message || '\"}', ',' "
        "ORDER BY list_pos) || ']}' AS json FROM z GROUP BY review_id, list_pos // 4",
        "reviews", "findings", "changes", ctes=_MERGED),
    "fix_outcome": oracle(
        "SELECT review_id, ready, outcome FROM oc", "reviews", "findings", ctes=_DECIDE),
    "pr_payload": oracle(
        "SELECT dc.review_id, CASE WHEN dc.review_id % 5 = 0 THEN 'Fix ' || CAST(dc.review_id AS STRING) ELSE "
        "'Automated fixes from AI code review' END AS title, 'ai-review-fixes/' || substr(head_sha, 1, 7) || "
        "'-' || CAST(1700000000000 + dc.review_id AS STRING) AS branch, dc.branch AS base_branch, 'fix: ' || "
        "CASE WHEN dc.review_id % 5 = 0 THEN 'Fix ' || CAST(dc.review_id AS STRING) ELSE 'Automated fixes "
        "from AI code review' END || chr(10) || chr(10) || 'Automated fixes generated from an AI code "
        "review.' AS commit_message, CASE dc.review_id % 5 WHEN 0 THEN 'Body' ELSE 'B' END || chr(10) || "
        "chr(10) || '---' || chr(10) || '_Opened automatically by the AI code review pipeline because this "
        "review''s findings crossed the auto-fix threshold._' || chr(10) || chr(10) || '**Files changed:**' "
        "|| chr(10) || CASE dc.review_id % 5 WHEN 0 THEN '- `src/m' || CAST(repo_id % 8 AS STRING) || '.js` "
        "— why' || chr(10) || '- `src/b.js` — ' ELSE '- `a.js` — ' END AS body, CAST(CASE dc.review_id % 5 "
        "WHEN 0 THEN 2 ELSE 1 END AS INT) AS files_changed FROM dc JOIN oc ON oc.review_id = dc.review_id "
        "WHERE ready", "reviews", "findings", ctes=_DECIDE),
    "report_assembly": oracle(
        f"SELECT v.review_id, v.repo_id, {_URL_V} AS repo_url, v.mode, v.branch AS default_branch, 'primary' "
        "AS provider_used, 'S' || CAST(v.review_id AS STRING) AS summary, CAST(v.review_id % 101 AS INT) AS "
        "score, issue_count, changed_file_count, lint_issues_found, ready AS pr_ready, outcome AS pr_reason, "
        "CASE v.review_id % 3 WHEN 0 THEN 'javascript,sql' WHEN 1 THEN 'python' END AS languages, linter || "
        "':' || status || ':' || CAST(n AS STRING) AS linter_runs, CAST(nw AS INT) AS warnings FROM rp v "
        "JOIN oc ON oc.review_id = v.review_id JOIN rs ON rs.review_id = v.review_id JOIN wm ON "
        "wm.repo_id = v.repo_id", "reviews", "findings", "changes", "metadata", "run_log", ctes=_REPORT),
    "persisted_review": oracle(
        "SELECT v.review_id, v.repo_id, v.mode, v.branch, CAST(CASE WHEN v.review_id % 2 = 0 THEN "
        "v.review_id % 101 ELSE v.repo_id % 50 END AS INT) AS score, 'S' || CAST(v.review_id AS STRING) AS "
        "summary, ready AS pr_created FROM fx_reviews v JOIN oc ON oc.review_id = v.review_id",
        "reviews", "findings", ctes=_DECIDE),
    "report_export": oracle(
        "SELECT review_id, seq // 1000000000000 AS part, CAST(count(*) AS INT) AS issues FROM fx_findings "
        "GROUP BY ALL", "findings"),
}
