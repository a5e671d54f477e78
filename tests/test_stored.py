"""Stored lint stages: equal to the lazy ones, each content scanned once, orphans ignored."""

import pytest
from pyspark.sql import functions as F

from reviewloom.catalog import queries
from reviewloom.operators import scan
from reviewloom.plans import review, stored

CODE = "import mongoose\nUser.find({})\nx.drop()"
TOKEN = "token = 'abcdefghijklmnop1234'"
FILES = [
    ("a", "src/app.js", CODE), ("a", "src/copy.js", CODE), ("a", "node_modules/lib.js", CODE), ("a", "run.py", "pass"),
    ("b", "src/app.js", CODE), ("b", "notes.txt", CODE), ("b", "README.md", TOKEN), ("b", "x.js", None),
    ("c", "src/app.js", CODE), ("c", "conf.js", TOKEN), ("d", ".env", "A=1"), ("d", "m.py", "import mongoose"), ("e", "docs/.env.example", TOKEN),
]
REPORTS = [("a", "eslint", "/w", '[{"filePath":"/w/src/app.js","messages":[{"line":1,"message":"m"}]}]'),
           ("b", "flake8", "/w", "a.py:1:1: E1 m"), ("c", "eslint", "/w", "[]")]
RUNS = [(r, l, True, None, None, None) for r in "abcd" for l in ("eslint", "flake8")]


@pytest.fixture(scope="module")
def inputs(spark):
    return (
        spark.createDataFrame(FILES, "repo_id string, path string, content string"),
        spark.createDataFrame(REPORTS, "repo_id string, linter string, root string, payload string"),
        spark.createDataFrame(RUNS, "repo_id string, linter string, ran boolean, error_code string, error_name string, error_message string"),
    )


def rows(table):
    return sorted(repr(sorted(r.asDict().items())) for r in table.collect())


def contents(spark, path):
    return {r["digest"] for r in spark.read.parquet(f"{path}/contents").collect()}


def test_equal_to_the_lazy_stage(spark, tmp_path, inputs):
    lazy = review.lint_stage(spark, *inputs)
    kept = stored.stored_lint_stage(spark, *inputs, str(tmp_path), "first")
    for name in ("secrets", "gate", "detections", "plan", "runs", "findings"):
        assert rows(getattr(kept, name)) == rows(getattr(lazy, name)), name
        assert rows(getattr(stored.read_lint_stage(spark, str(tmp_path), "first"), name)) == rows(getattr(lazy, name))
    assert kept.findings.where(F.col("linter") == scan.ANALYZER).count() > 0
    # Six different contents among thirteen files; no copy of them is left behind.
    assert len(contents(spark, str(tmp_path))) == spark.read.parquet(f"{tmp_path}/contents").count() == 6
    assert not list(tmp_path.glob("work-*"))


def test_second_job_scans_only_what_changed(spark, tmp_path, inputs, monkeypatch):
    files, reports, run_log = inputs
    stored.stored_lint_stage(spark, *inputs, str(tmp_path))
    before = contents(spark, str(tmp_path))
    scanned = []
    whole = stored._hits
    monkeypatch.setattr(stored, "_hits", lambda new: scanned.append(new.count()) or whole(new))
    changed = files.where("path <> 'run.py'").unionByName(
        spark.createDataFrame([("a", "run.py", "print(1)")], files.schema))
    kept = stored.stored_lint_stage(spark, changed, reports, run_log, str(tmp_path))
    assert scanned == [1] and len(contents(spark, str(tmp_path)) - before) == 1
    assert rows(kept.findings) == rows(review.lint_stage(spark, changed, reports, run_log).findings)
    stored.stored_lint_stage(spark, changed, reports, run_log, str(tmp_path))
    assert scanned == [1]
    # Other rules: everything is scanned again.
    monkeypatch.setattr(stored, "rules_version", lambda: "other")
    again = stored.stored_lint_stage(spark, changed, reports, run_log, str(tmp_path))
    assert scanned == [1, 6] and rows(again.secrets) == rows(kept.secrets)


def test_hits_of_a_job_that_died_are_not_read(spark, tmp_path, inputs):
    files = inputs[0]
    digest = stored._digest

    listing = files.select("repo_id", "path", digest().alias("digest"))
    stored.scan_new_contents(files, listing, str(tmp_path / "good"))
    whole = rows(stored.scan_new_contents(files, listing, str(tmp_path / "good")).drop("batch"))
    # The hits are written, the digests are not.
    hits = stored._hits(files.select(digest().alias("digest"), "content")).withColumns(
        {"version": F.lit(stored.rules_version()), "batch": F.lit("dead")})
    hits.write.parquet(str(tmp_path / "bad" / "hits"))
    got = stored.scan_new_contents(files, listing, str(tmp_path / "bad"))
    assert rows(got.drop("batch")) == whole and got.where("batch = 'dead'").count() == 0


@pytest.mark.parametrize("name", ["full_review_job", "incremental_review_job"])
def test_job_reads_written_tables(spark, name):
    job = queries()[name](spark, "/root/testdata/sf0.001")
    plan = job._jdf.queryExecution().executedPlan().toString()
    given = [line for line in plan.splitlines() if "FileScan parquet" in line and "/testdata/" in line]
    assert len(given) <= 3 and not any("lineitem" in line for line in given)
