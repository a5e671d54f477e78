"""Diff prompts are put together from tables that are written once."""

from reviewloom.plans import prompts


def frames(spark):
    reviews = spark.createDataFrame([(1, "u"), (2, "u")], "review_id int, repo_url string")
    changes = spark.createDataFrame(
        [(k, i, f"f{i}.js", None, "modified", f"+{i}") for k in (1, 3) for i in range(5)],
        "review_id int, file_no int, filename string, previous_filename string, status string, patch string")
    findings = spark.createDataFrame(
        [(k, i, f"f{i % 9}.js" if i else None, i, "error", "r", f"m{i}") for k in (1, 2, 3) for i in range(40)],
        "review_id int, seq bigint, file string, line int, severity string, rule_id string, message string")
    return reviews, changes, findings


def test_findings_of_changed_files_only(spark):
    rows = prompts.incremental_prompts(*frames(spark)).collect()
    assert {(r["review_id"], r["section"]) for r in rows} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 3)}
    lint = sorted((r["file_order"], r["file"], r["text"].count("\n") + 1) for r in rows if r["section"] == 2)
    # Below the heading (two lines), files in the order of their first finding.
    assert lint == [(-1, "", 2), (1, "f1.js", 5), (2, "f2.js", 5), (3, "f3.js", 5), (4, "f4.js", 4), (9, "f0.js", 4)]


def test_pieces_are_written_once(spark):
    """The passes over the pieces read them; only the last join of findings is left above the scans."""
    plan = prompts.incremental_prompt_parts(*frames(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "Generate" not in plan
