"""Decisions, prompts and whole review jobs on literal input."""

import json

from pyspark.sql import functions as F

from reviewloom.operators import history, merge, scoring
from reviewloom.operators.lint_reports import normalize_lint_reports
from reviewloom.plans import fixes, prompts, review
from reviewloom.sources import tables

FINDING = ("review_id int, seq bigint, file string, line int, severity string, rule_id string, "
           "message string")


def decide(spark, score, severities, **options):
    reviews = spark.createDataFrame([(1, score)], "review_id int, score int")
    issues = spark.createDataFrame([(1, s) for s in severities], "review_id int, severity string")
    row = scoring.pr_decisions(reviews, issues, **options).collect()[0]
    return row["should_open_pr"], row["reason"], row["weighted"]


def test_pr_decision(spark):
    none = "no error/warning-level issues found"
    under = "issues present but under both thresholds"
    assert decide(spark, 10, ["info"] * 5) == (False, none, 0)
    assert decide(spark, 59, ["warning"]) == (True, "health score 59 is below threshold 60", 1)
    assert decide(spark, 60, ["warning"] * 7) == (False, under, 7)
    assert decide(spark, 90, ["error", "error", "warning", "warning"]) == (
        True, "weighted issue score 8 is at/above threshold 8", 8)
    assert decide(spark, 90, []) == (False, none, 0)
    assert decide(spark, 78, ["error", "warning", "warning", "info"]) == (False, under, 5)
    assert decide(spark, None, ["error"] * 4) == (False, "no score", 12)
    assert decide(spark, 90, ["odd", "warning"], min_severity="error") == (False, none, 1)
    assert decide(spark, 90, ["warning"], weighted_threshold=1)[0] is True


def test_full_prompt_text(spark):
    reviews = spark.createDataFrame(
        [(1, "u", [("REPO_FORK", "fork")], ["skipped 2"]), (2, "v", [], None)],
        "review_id int, repo_url string, warnings array<struct<code:string,message:string>>, notices array<string>")
    findings = spark.createDataFrame([
        (1, 1, "a.js", 3, "info", "r1", "low"), (1, 2, "b.js", None, "error", "r2", "bad"),
        (1, 3, "a.js", 5, "error", None, "worse")], FINDING)
    runs = spark.createDataFrame([
        (1, 0, "eslint", "success", None, None, 2), (1, 1, "flake8", "failed", "binary_not_found", "x", 0),
        (1, 2, "clippy", "failed", "runtime_error", "boom", 0), (1, 3, "ktlint", "skipped", None, None, 0)],
        "review_id int, registry_pos int, linter string, status string, reason string, error string, "
        "files_with_issues int")
    languages = spark.createDataFrame([(1, 1, "python"), (1, 0, "javascript")],
                                      "review_id int, registry_pos int, language string")
    got = {r["review_id"]: r["prompt"] for r in prompts.full_prompts(reviews, findings, runs, languages).collect()}
    assert got[1] == "\n".join([
        "## Repository: u", "## Detected Languages: javascript, python", "",
        "## Repository Metadata Warnings", "- [REPO_FORK] fork", "",
        "## Secret Scan Notices", "- skipped 2", "",
        "## Linter Run Summary", "- eslint: ✓ 2 files with issues", "- flake8: ✗ not installed",
        "- clippy: ✗ boom", "", "## Lint Findings (showing 3 of 3 total)",
        "", "### a.js", "  [ERROR] L5 [null] worse", "  [INFO] L3 [r1] low",
        "", "### b.js", "  [ERROR] L? [r2] bad", "", "---",
        "Analyze the above findings and produce a structured JSON review report."])
    assert "## Detected Languages: unknown" in got[2] and "No lint issues found." in got[2]
    assert "Warnings" not in got[2] and "Notices" not in got[2]


def test_incremental_parts_make_the_whole(spark):
    reviews = spark.createDataFrame([(1, "u")], "review_id int, repo_url string")
    changes = spark.createDataFrame(
        [(1, i, f"f{i}.js", None, "modified", f"+{i}") for i in range(7)],
        "review_id int, file_no int, filename string, previous_filename string, status string, patch string")
    findings = spark.createDataFrame(
        [(1, i, f"f{i % 9}.js", i, "error", "r", f"m{i}") for i in range(40)], FINDING)
    order = ["section", "file_order", "file", "part"]

    def text(rows):
        return "\n".join(r["text"] for r in rows.orderBy(*order).collect())

    whole = text(prompts.incremental_prompts(reviews, changes, findings))
    parts = prompts.incremental_prompts(reviews, changes, findings, rows_per_part=3)
    assert parts.count() > 20 and text(parts) == whole
    assert "f7.js" not in whole and "f8.js" not in whole


def test_incremental_prompt_ignores_unrelated_findings(spark):
    reviews = spark.createDataFrame([(1, "u")], "review_id int, repo_url string")
    changes = spark.createDataFrame(
        [(1, 0, "a.js", None, "modified", "+x")],
        "review_id int, file_no int, filename string, previous_filename string, status string, patch string")
    findings = spark.createDataFrame([(1, i, "other.js", i, "error", "r", f"m{i}") for i in range(6000)], FINDING)
    rows = prompts.incremental_prompts(reviews, changes, findings).collect()
    assert sorted(r["section"] for r in rows) == [0, 1, 3] and sum(len(r["text"]) for r in rows) < 300


def test_review_job_end_to_end(spark):
    files = spark.createDataFrame([
        ("a", "src/app.js", "const m = require('mongoose')\nUser.find({})\n"), ("a", "server.py", "x = 1\n"),
        ("b", "k.js", 'const token = "abcdefghij0123456789"'), ("c", "m.go", "")],
        "repo_id string, path string, content string")
    reports = spark.createDataFrame([
        ("a", "flake8", "/w", "server.py:1:1: E1 m"), ("a", "clippy", "/w", "ignored"),
        ("c", "golangci-lint", "/w", '{"Issues":[{"Pos":{"Filename":"m.go"}}]}'),
        ("a", "eslint", "/w", '[{"filePath":"/w/src/app.js","messages":[{"severity":2,"message":"e"}]}]')],
        "repo_id string, linter string, root string, payload string")
    log = spark.createDataFrame([
        ("a", "flake8", True, None, None, None), ("a", "eslint", True, None, None, None),
        ("c", "golangci-lint", True, "ENOENT", "Error", "x")],
        "repo_id string, linter string, ran boolean, error_code string, error_name string, error_message string")
    stage = review.lint_stage(spark, files, reports, log)
    assert {(r["repo_id"], r["linter"], r["status"], r["issue_count"]) for r in stage.runs.collect()} == {
        ("a", "flake8", "success", 1), ("a", "eslint", "success", 1), ("a", "mongodb-analyzer", "success", 2),
        ("c", "golangci-lint", "failed", 0)}
    requests = spark.createDataFrame([
        ("a", 1, "https://github.com/o/a"), ("b", 2, "https://github.com/o/b"), ("c", 3, "https://github.com/o/c"),
        ("d", 4, "https://github.com/o/d")], "repo_id string, review_id int, repo_url string")
    metadata = spark.createDataFrame(
        [(r, False, False, r == "a", False, 10, "main", True, 50, 200, None, True) for r in "abc"],
        "repo_id string, archived boolean, disabled boolean, fork boolean, private boolean, size_kb long, "
        "default_branch string, has_commits boolean, rate_remaining int, http_status int, "
        "response_message string, has_token boolean")
    admitted = review.admit(requests, metadata, stage.gate)
    assert {r["repo_id"]: r["error_code"] for r in admitted.collect()} == {
        "a": None, "b": "SECRETS_FOUND", "c": None, "d": "REPO_NOT_FOUND"}
    got = {r["review_id"]: r["prompt"] for r in review.full_review_prompts(admitted, stage).collect()}
    assert set(got) == {1, 3}
    assert "## Detected Languages: javascript, python, mongodb" in got[1]
    assert "showing 4 of 4" in got[1] and "[REPO_FORK]" in got[1]
    assert "golangci-lint: ✗ not installed" in got[3] and "No lint issues found." in got[3]
    changes = spark.createDataFrame(
        [(1, 0, "server.py", None, "modified", None)],
        "review_id int, file_no int, filename string, previous_filename string, status string, patch string")
    parts = review.incremental_review_prompts(admitted, stage, changes).orderBy("section", "file_order", "file", "part")
    diff = {1: "\n".join(r["text"] for r in parts.where("review_id = 1").collect())}
    assert "(no patch available" in diff[1] and "server.py:L1 [E1] m" in diff[1] and "app.js" not in diff[1]


def test_reports_without_a_run_are_not_parsed(spark):
    """The reports meet the runs that count below the parser, whose results are the same."""
    files = spark.createDataFrame([("a", "server.py", "x = 1\n")], "repo_id string, path string, content string")
    reports = spark.createDataFrame(
        [("a", "flake8", "/w", "server.py:1:1: E1 m"), ("a", "clippy", "/w", "ignored"), ("z", "flake8", "/w", "z.py:1:1: E1 m")],
        "repo_id string, linter string, root string, payload string")
    log = spark.createDataFrame(
        [("a", "flake8", True, None, None, None), ("z", "flake8", True, None, None, None)],
        "repo_id string, linter string, ran boolean, error_code string, error_name string, error_message string")
    findings = review.lint_stage(spark, files, reports, log).findings
    assert [(r["repo_id"], r["linter"], r["file"]) for r in findings.collect()] == [("a", "flake8", "server.py")]
    plan = findings._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode(CASE WHEN (linter"):]
    assert below[below.index("Join "):].startswith("Join LeftSemi")


def test_several_reports_of_one_tool_keep_their_order(spark):
    reports = spark.createDataFrame(
        [("a", "flake8", "/w", f"f{p}.py:{n}:1: E1 m\nf{p}.py:{n + 1}:1: E1 m", p) for p, n in ((1, 3), (0, 7))],
        "repo_id string, linter string, root string, payload string, report_pos int")
    found = normalize_lint_reports(reports).withColumn("review_id", F.lit(1))
    rows = review.with_list_position(found).orderBy("seq").collect()
    assert [(r["seq"], r["file"], r["line"]) for r in rows] == [
        (1, "f0.py", 7), (2, "f0.py", 8), (3, "f1.py", 3), (4, "f1.py", 4)]


def test_pr_payload_and_outcomes(spark):
    reviews = spark.createDataFrame(
        [(n, "r", 10, "abcdef0123", "main", "u", 5, n != 2) for n in (1, 2, 3, 4)],
        "review_id int, repo_id string, score int, head_sha string, base_branch string, repo_url string, "
        "epoch_ms long, has_token boolean")
    issues = spark.createDataFrame([(n, "error") for n in (1, 2, 3)], "review_id int, severity string")
    candidates = fixes.fix_candidates(reviews, issues)
    answers = spark.createDataFrame(
        [(n, '{"prTitle":"T","prBody":"B","fixes":[{"file":"a","newContent":"x","explanation":"e"}]}')
         for n in (1, 2)], "review_id int, text string")
    got = {r["review_id"]: (r["ready"], r["outcome"]) for r in fixes.fix_outcomes(candidates, answers).collect()}
    low = "health score 10 is below threshold 60"
    assert got == {1: (True, low), 2: (False, fixes.NO_TOKEN), 3: (False, fixes.NO_FIXES),
                   4: (False, "no error/warning-level issues found")}
    row = fixes.fix_plan(candidates, answers).collect()
    assert [r["review_id"] for r in row] == [1]
    assert row[0]["branch"] == "ai-review-fixes/abcdef0-5"
    assert row[0]["commit_message"].startswith("fix: T\n\n") and row[0]["body"].endswith("- `a` — e")


def test_history_tables(spark, tmp_path):
    reviews = spark.sql(
        "SELECT 'x' AS review_id, 'r' AS repo_id, 'full' AS mode, CAST(NULL AS STRING) AS base_sha, 'h1' AS head_sha, "
        "'main' AS branch, 70 AS score, 's' AS summary, false AS pr_created, CAST(NULL AS STRING) AS pr_url, "
        "CAST(NULL AS INT) AS pr_number, TIMESTAMP'2024-01-01' AS created_at UNION ALL "
        "SELECT 'y', 'r', 'incremental', 'h1', 'h2', 'dev', NULL, 's', false, NULL, NULL, TIMESTAMP'2024-02-01'")
    path = str(tmp_path / "reviews")
    tables.append_reviews(reviews.where("review_id = 'x'"), path)
    tables.append_reviews(reviews.where("review_id = 'y'"), path)
    stored = tables.read_reviews(spark, path)
    assert stored.count() == 2
    pointer = history.last_reviewed_pointers(stored).collect()[0]
    assert (pointer["last_reviewed_sha"], pointer["last_reviewed_branch"]) == ("h2", "dev")
    scores = {r["review_id"]: r["stored_score"] for r in history.with_carried_score(stored).collect()}
    assert scores == {"x": 70, "y": 70}
    issues = spark.createDataFrame([("x", i, "a") for i in range(5)], "review_id string, seq bigint, file string")
    docs = [json.loads(r["json"]) for r in tables.issue_json(issues, 2).orderBy("part").collect()]
    assert [i["seq"] for d in docs for i in d["issues"]] == [0, 1, 2, 3, 4] and len(docs) == 3
    out = str(tmp_path / "export")
    tables.export_json(stored, out)
    assert spark.read.json(out).count() == 2


def test_scope_of_incremental_review(spark):
    findings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "review_id int, file string")
    changes = spark.createDataFrame([(1, "a"), (1, "a")], "review_id int, filename string")
    kept = merge.in_changed_files(findings, changes, ["review_id"])
    assert [(r["review_id"], r["file"]) for r in kept.collect()] == [(1, "a")]
