"""Whole review jobs from files, reports, run log and metadata to prompts.

Every document is a repository of one file; line items are lint reports of some of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.reports import expected_rows
from reviewloom.catalog.scans import SECRET_EXPRESSIONS
from reviewloom.catalog.views import RANK, oracle
from reviewloom.operators.languages import REGISTRY
from reviewloom.operators.scan import ANALYZER, MONGO_RULES, PREFER_LEAN
from reviewloom.plans import review, stored
from reviewloom.session import scratch_dir, staged
from reviewloom.sources.samples import LINTERS, Samples

_REPO = "concat('doc', CAST(doc_id AS STRING))"
# The changed file of each kind of repository, which the reports of its tool name.
_CHANGED = (
    "src/m1.js", "pkg/m1.py", "src/m1.rs", "pkg/m1.go", "src/M1.java", "lib/m1.rb", "m1.php", "m1.cpp", "M1.swift",
    "src/M1.kt", "bin/m1.sh", "db/m1.sql",
)
_CHANGED_FILE = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_CHANGED))
_CHANGED_FILE = f"CASE {{key}} % 15 {_CHANGED_FILE} ELSE 'src/m1.js' END"


def _stage(spark, s: Samples):
    """Written once, into a folder of its own; later steps read the tables."""
    documents = s.table("documents")
    run_log = documents.select(
        "doc_id", F.explode(F.array(*[F.lit(name) for name in LINTERS])).alias("linter")
    ).selectExpr(
        f"{_REPO} AS repo_id", "linter", "doc_id % 19 <> 4 AS ran",
        "CASE WHEN doc_id % 7 = 5 THEN 'ENOENT' END AS error_code", "CAST(NULL AS STRING) AS error_name",
        "CASE WHEN doc_id % 7 = 5 THEN 'spawn' END AS error_message",
    )
    reports = s.mixed_reports(
        f"concat('doc', CAST(l_orderkey % {documents.count()} AS STRING))",
        "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS report_pos",
    )
    return stored.stored_lint_stage(spark, s.view("job_files"), reports, run_log, scratch_dir(spark, "review"))


def _admitted(s: Samples, stage):
    requests = s.table("documents").selectExpr(
        f"{_REPO} AS repo_id", "doc_id AS review_id",
        "concat('https://github.com/o/r', CAST(doc_id AS STRING)) AS repo_url",
    )
    # Every later step is keyed by the admitted requests, so they are written once as well.
    return staged(review.admit(requests, s.view("job_metadata"), stage.gate), "admitted")


def full_review_job(spark, sf_dir):
    s = Samples(spark, sf_dir)
    stage = _stage(spark, s)
    return review.full_review_prompts(_admitted(s, stage), stage)


def incremental_review_job(spark, sf_dir):
    """Every review changed one file, which some of its findings name."""
    s = Samples(spark, sf_dir)
    stage = _stage(spark, s)
    changes = s.table("documents").selectExpr(
        "doc_id AS review_id", "0 AS file_no",
        _CHANGED_FILE.format(key="doc_id") + " AS filename",
        "CAST(NULL AS STRING) AS previous_filename", "'modified' AS status", "'+x' AS patch",
    )
    return review.incremental_review_prompts(_admitted(s, stage), stage, staged(changes, "changes")).select(
        "review_id", "section", "file_order", "file", F.col("part").cast("bigint").alias("part"), "text")


_LANGUAGE = "CASE {key} % 15 " + " ".join(f"WHEN {k} THEN '{e[0]}'" for k, e in enumerate(REGISTRY[:12])) + (
    " WHEN 14 THEN 'javascript' END")
_TOOL = "CASE language " + " ".join(f"WHEN '{e[0]}' THEN '{e[1]}'" for e in REGISTRY[:12]) + " END"
_OWN_REPORTS = " UNION ALL ".join(
    "SELECT l_orderkey % (SELECT count(*) FROM documents) AS review_id, "
    "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS report_pos, "
    f"{file} AS file, CAST({seq} AS BIGINT) AS seq, CAST({line} AS INT) AS line, {severity} AS severity, {message} AS message, "
    f"{rule} AS rule_id, {turn} AS tool, '{entry[0]}' AS language FROM lineitem "
    f"WHERE l_partkey % 10 <> 0 AND (l_orderkey + l_linenumber) % 12 = {turn}"
    for turn, entry in enumerate(REGISTRY[:12])
    for file, seq, line, _, severity, message, rule in expected_rows(entry[1])
)
_ANALYZED = " UNION ALL ".join(
    f"SELECT v.review_id, 0 AS report_pos, j.path AS file, CAST({place * 2 ** 32 + 2} AS BIGINT) AS seq, 2 AS line, "
    f"'{rule.severity}' AS severity, '{rule.message}' AS message, '{rule.rule_id}' AS rule_id, 12 AS tool "
    f"FROM v JOIN fx_job_files j ON j.repo_id = concat('doc', CAST(v.review_id AS STRING)) WHERE v.analyzed"
    for place, rule in ((1, MONGO_RULES[1]), (len(MONGO_RULES), PREFER_LEAN))
)
_JOB = (
    "n AS (SELECT repo_id, unnest(string_split(content, chr(10))) AS t FROM fx_job_files), "
    f"blocked AS (SELECT DISTINCT repo_id FROM n WHERE {SECRET_EXPRESSIONS}), "
    # One file each: ignored and hidden folders and generated or unknown files give no language.
    "v AS (SELECT *, language = 'javascript' AND review_id % 4 < 3 AS analyzed FROM ("
    "SELECT doc_id AS review_id, doc_id % 7 = 5 AS missing, doc_id % 19 <> 4 AS ran, doc_id % 11 = 0 AS archived, "
    f"CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN {_LANGUAGE.format(key='doc_id')} END AS language FROM documents "
    f"WHERE doc_id % 17 <> 3 AND {_REPO} NOT IN (SELECT repo_id FROM blocked)) d), "
    f"r0 AS ({_OWN_REPORTS}), "
    "r1 AS (SELECT r0.* EXCLUDE (language) FROM r0 JOIN v ON v.review_id = r0.review_id AND v.language = r0.language "
    f"WHERE ran AND NOT missing UNION ALL {_ANALYZED}), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY tool, report_pos, seq, file, line, rule_id, "
    "message) AS pos FROM r1)"
)
_BLOCKS = (
    "o AS (SELECT review_id, file, min(pos) AS file_order FROM f GROUP BY ALL), "
    f"k AS (SELECT f.*, row_number() OVER (PARTITION BY f.review_id ORDER BY {RANK}, file_order, f.file, pos, message) "
    "AS rank FROM f JOIN o ON o.review_id = f.review_id AND o.file = f.file), "
    "g AS (SELECT *, dense_rank() OVER (PARTITION BY review_id ORDER BY first_rank) AS file_rank FROM (SELECT *, "
    "min(rank) OVER (PARTITION BY review_id, file) AS first_rank FROM k WHERE rank <= 60) a), "
    "h AS (SELECT review_id, file_rank, chr(10) || '### ' || file || chr(10) || string_agg('  [' || upper(severity) || "
    "'] L' || CAST(line AS STRING) || ' [' || rule_id || '] ' || message, chr(10) ORDER BY rank) AS block FROM g "
    "WHERE file_rank <= 20 GROUP BY review_id, file_rank, file), "
    "b AS (SELECT review_id, string_agg(block, chr(10) ORDER BY file_rank) AS blocks FROM h GROUP BY review_id), "
    "t AS (SELECT review_id, count(*) AS total, count(DISTINCT CASE WHEN tool < 12 THEN file END) AS files FROM f "
    "GROUP BY review_id)"
)
QUERIES = {"full_review_job": full_review_job, "incremental_review_job": incremental_review_job}

ORACLES = {
    "full_review_job": oracle(
        "SELECT v.review_id, '## Repository: https://github.com/o/r' || CAST(v.review_id AS STRING) || chr(10) || "
        "'## Detected Languages: ' || CASE language WHEN 'javascript' THEN 'javascript, mongodb' ELSE "
        "coalesce(language, 'unknown') END || chr(10) || chr(10) || CASE WHEN archived THEN '## Repository Metadata "
        "Warnings' || chr(10) || '- [REPO_ARCHIVED] Repository is archived. Review results may be outdated.' || chr(10) "
        "|| chr(10) ELSE '' END || '## Linter Run Summary' || chr(10) || CASE WHEN language IS NULL OR NOT ran THEN '' "
        f"WHEN missing THEN '- ' || {_TOOL} || ': ✗ not installed' || chr(10) ELSE '- ' || {_TOOL} || ': ✓ ' || "
        "CAST(coalesce(files, 0) AS STRING) || ' files with issues' || chr(10) END || CASE WHEN language = 'javascript' "
        f"THEN '- {ANALYZER}: ✓ ' || CASE WHEN analyzed THEN '1' ELSE '0' END || ' files with issues' || chr(10) ELSE '' END || chr(10) || '## Lint Findings "
        "(showing ' || CAST(least(60, coalesce(total, 0)) AS STRING) || ' of ' || CAST(coalesce(total, 0) AS STRING) || "
        "' total)' || chr(10) || coalesce(blocks, 'No lint issues found.') || chr(10) || chr(10) || '---' || chr(10) || "
        "'Analyze the above findings and produce a structured JSON review report.' AS prompt FROM v "
        "LEFT JOIN b ON b.review_id = v.review_id LEFT JOIN t ON t.review_id = v.review_id",
        "job_files", ctes=_JOB + ", " + _BLOCKS),
    "incremental_review_job": oracle(
        "SELECT review_id, section, file_order, file, part, string_agg(text, chr(10) ORDER BY pos) AS text FROM u "
        "GROUP BY ALL", "job_files", ctes=_JOB + ", "
        f"c AS (SELECT review_id, {_CHANGED_FILE.format(key='review_id')} AS file FROM v), l AS (SELECT f.* FROM f JOIN c ON c.review_id = f.review_id AND c.file = f.file), "
        "u AS (SELECT review_id, 0 AS section, CAST(0 AS BIGINT) AS file_order, '' AS file, CAST(0 AS BIGINT) AS part, "
        "CAST(0 AS BIGINT) AS pos, '## Repository: https://github.com/o/r' || CAST(review_id AS STRING) || chr(10) || "
        "'## Files changed in this diff: 1' || chr(10) || chr(10) || '## Diff' AS text FROM v UNION ALL "
        "SELECT review_id, 1, 0, '', 0, 0, chr(10) || '### ' || file || ' (modified)' || chr(10) || '```diff' || chr(10) "
        "|| '+x' || chr(10) || '```' FROM c UNION ALL "
        "SELECT DISTINCT review_id, 2, -1, '', 0, 0, chr(10) || '## Lint findings for changed files' FROM l UNION ALL "
        "SELECT review_id, 2, min(pos) OVER (PARTITION BY review_id, file), file, pos // 4096, pos, '  [' || "
        "upper(severity) || '] ' || file || ':L' || CAST(line AS STRING) || ' [' || rule_id || '] ' || message FROM l "
        "UNION ALL SELECT review_id, 3, 0, '', 0, 0, chr(10) || '---' || chr(10) || 'Review only the diff above and "
        "produce the structured JSON review report.' FROM v)"),
}
