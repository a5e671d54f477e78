"""Literal payloads of the lint formats."""

import json

from pyspark.sql import functions as F

from reviewloom.operators import lint_reports, runs


def parse(spark, linter, payload, root="/w"):
    frame = spark.createDataFrame(
        [("r", linter, root, payload)], "repo_id string, linter string, root string, payload string"
    )
    found = lint_reports.FORMATS[linter](frame).orderBy("seq").collect()
    return [(r["file"], r["line"], r["column"], r["severity"], r["message"], r["rule_id"]) for r in found]


def test_junk_gives_no_rows(spark):
    rows = [
        ("r", name, "/w", payload)
        for name in lint_reports.FORMATS for payload in ("", "  ", "junk", "[", "{", None, "7", "{}", "[]")
    ]
    frame = spark.createDataFrame(rows, "repo_id string, linter string, root string, payload string")
    assert lint_reports.normalize_lint_reports(frame).count() == 0


def test_wrong_root_kind(spark):
    assert parse(spark, "swiftlint", '{"file":"a","line":1}') == []
    assert parse(spark, "golangci-lint", '[{"Issues":[]}]') == []


def test_eslint(spark):
    payload = json.dumps([
        {"filePath": "/w/src/a.js", "messages": [
            {"line": 3, "column": 0, "severity": 2, "message": "m", "ruleId": "r"},
            {"severity": 1, "message": "n", "ruleId": None},
            {"severity": "2", "message": "o"},
        ]},
        {"filePath": "/w/b.js", "messages": []},
    ])
    assert parse(spark, "eslint", payload) == [
        ("src/a.js", 3, 0, "error", "m", "r"),
        ("src/a.js", 1, 1, "warning", "n", "eslint/unknown"),
        ("src/a.js", 1, 1, "info", "o", "eslint/unknown"),
    ]


def test_flake8(spark):
    payload = "./a.py:3:1: E501 line too long\na.py:1:1: SIM102 x\n /w/c d.py:2:9: W1 y \r\nnoise"
    assert parse(spark, "flake8", payload) == [
        ("a.py", 3, 1, "warning", "line too long", "E501"),
        ("c d.py", 2, 9, "warning", "y", "W1"),
    ]


def test_clippy(spark):
    lines = [
        {"reason": "compiler-message", "message": {"message": "m", "level": "error", "code": {"code": "c"},
         "spans": [{"file_name": "a.rs", "line_start": 1, "column_start": 1, "is_primary": False},
                   {"file_name": "b.rs", "line_start": 5, "column_start": 6, "is_primary": True}]}},
        {"reason": "compiler-message", "message": {"message": "none", "spans": []}},
        {"reason": "compiler-artifact"},
        {"reason": "compiler-message", "message": {"message": "n", "level": "help", "code": None,
         "spans": [{"file_name": "c.rs"}]}},
    ]
    payload = "\n".join(["bad {", *map(json.dumps, lines)])
    assert parse(spark, "clippy", payload) == [
        ("b.rs", 5, 6, "error", "m", "c"), ("c.rs", 1, 1, "info", "n", "clippy/unknown"),
    ]


def test_checkstyle_cut_at_slash(spark):
    payload = (
        '<?xml version="1.0"?><checkstyle><file name="/w/A.java">'
        '<error line="0" column="4" severity="warning" message="a &lt; b" source="x.y.LineLength"/>'
        '<error line="2" severity="error" message="use a/b" source="x.Y"/></file></checkstyle>'
    )
    assert parse(spark, "checkstyle", payload) == [
        ("A.java", 1, 4, "warning", "a < b", "checkstyle/LineLength"),
        ("A.java", 2, 1, "error", "", "checkstyle/unknown"),
    ]


def test_checkstyle_strict(spark):
    payload = (
        '<checkstyle><file name="/w/A.java"><error line="2" severity="error" message="use a/b" '
        'source="x.Y"/></file></checkstyle>'
    )
    frame = spark.createDataFrame([("r", "/w", payload)], "repo_id string, root string, payload string")
    row = lint_reports.checkstyle_strict(frame).collect()[0]
    assert (row["file"], row["message"], row["rule_id"]) == ("A.java", "use a/b", "checkstyle/Y")


def test_cppcheck_borrows_location(spark):
    payload = (
        '<results><error id="a" severity="style" msg="&amp;lt;"/><error id="b" severity="error" msg="n">\n'
        '<location file="/w/x.c" line="4" col="2"/></error>'
        '<error id="own" file="y.c" line="9" severity="none"/><error id="lost" severity="error"/></results>'
    )
    assert parse(spark, "cppcheck", payload) == [
        ("x.c", 4, 2, "warning", "<", "cppcheck/a"),
        ("x.c", 4, 2, "error", "n", "cppcheck/b"),
        ("y.c", 9, 1, "info", "", "cppcheck/own"),
    ]


def test_remaining_formats(spark):
    assert parse(spark, "shellcheck", '[{"file":"a.sh","line":2,"column":3,"level":"style","code":2086,"message":"q"}]') == [
        ("a.sh", 2, 3, "warning", "q", "shellcheck/SC2086")]
    assert parse(spark, "phpcs", '{"files":{"/w/a.php":{"messages":[{"type":"ERROR","line":4}]}}}') == [
        ("a.php", 4, 1, "error", "", "phpcs/unknown")]
    assert parse(spark, "rubocop", '{"files":[{"path":"a.rb","offenses":[{"severity":"convention"}]}]}') == [
        ("a.rb", 1, 1, "info", "", "rubocop/unknown")]
    assert parse(spark, "sqlfluff", '[{"filepath":"a.sql","violations":[{"line_no":1,"line_pos":2,"code":"L1","description":"d"}]}]') == [
        ("a.sql", 1, 2, "warning", "d", "sqlfluff/L1")]


def test_run_classification_and_text(spark):
    log = [
        ("r", "flake8", True, "ENOENT", "Error", "spawn"), ("r", "eslint", True, None, None, None),
        ("r", "phpcs", True, None, "SyntaxError", "bad"), ("r", "ktlint", True, "X", None, "boom"),
        ("r", "clippy", False, None, None, None), ("r", "rubocop", True, None, None, None),
    ]
    frame = spark.createDataFrame(
        log, "repo_id string, linter string, ran boolean, error_code string, error_name string, error_message string"
    )
    findings = spark.createDataFrame([("r", "eslint", "a.js")], "repo_id string, linter string, file string")
    rows = runs.with_counts(runs.classify_runs(frame), findings).withColumn("t", runs.status_text())
    got = {r["linter"]: (r["status"], r["reason"], r["t"]) for r in rows.collect()}
    assert got == {
        "flake8": ("failed", "binary_not_found", "Not installed on this server"),
        "eslint": ("success", None, "1 issue"),
        "phpcs": ("failed", "parse_error", "Did not run"),
        "ktlint": ("failed", "runtime_error", "Did not run"),
        "clippy": ("skipped", None, "Skipped — no matching files"),
        "rubocop": ("success", None, "Clean"),
    }


REPORTS = "repo_id string, linter string, root string, payload string"


def test_large_report_keeps_all_findings(spark, tmp_path):
    entry = json.dumps({"file": "z.sh", "line": 3, "message": "long text " * 95})
    n = 140_000
    spark.createDataFrame([("r", "shellcheck", "/w", "")], REPORTS).withColumn(
        "payload", F.concat(F.lit("["), F.repeat(F.lit(entry + ","), n), F.lit(entry + "]"))
    ).write.parquet(str(tmp_path / "reports"))
    reports = spark.read.parquet(str(tmp_path / "reports"))
    assert reports.select(F.octet_length("payload")).first()[0] > 135_000_000
    assert lint_reports.normalize_lint_reports(reports).count() == n + 1


def test_exactly_one_value(spark):
    item = '{"file":"a","line":1}'
    mark = "~~ end of value ~~"
    cases = {
        f"[{item}]": 1, f" \n[{item},{item}]\t": 2, f"[{item}] x": 0, f"[{item}][{item}]": 0, f"[{item}],[{item}]": 0,
        f"[{item}]]": 0, f"[{item}": 0, f'[{item}],"b":[{item}]': 0, f"[{item}]],[[{item}]": 0, "[{'file':'a'}]": 0,
        '[{"file":"a","line":NaN}]': 0, '[{"file":"a","line":"7"}]': 1, f'[{item},null,{{"file":""}}]': 1, f'[{item},3]': 0,
        f'[{{"file":"{mark}"}}]': 1, f'[{item}],[{{"~end":"{mark}"}}]]': 0, f'[{{"file":"a","~end":"{mark}"}}]': 1, item: 0,
    }
    for payload, n in cases.items():
        frame = spark.createDataFrame([("r", "shellcheck", "/w", payload)], REPORTS)
        assert lint_reports.normalize_lint_reports(frame).count() == n, payload


def test_one_scan_and_one_generator_for_all_tools(spark, tmp_path):
    spark.createDataFrame([], REPORTS).write.parquet(str(tmp_path / "reports"))
    found = lint_reports.normalize_lint_reports(spark.read.parquet(str(tmp_path / "reports")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Generate explode") == 1
    # Nine JSON layouts and no variant; each is named once, in the generator.
    assert plan.count("from_json(") == 9 and "parse_json" not in plan


def test_plugged_in_tool(spark):
    def lines(reports):
        return reports.select(
            "repo_id", F.lit("own").alias("linter"), F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("seq"),
            F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("info").alias("severity"),
            F.col("payload").alias("message"), F.lit("own/x").alias("rule_id"), F.lit("own").alias("source"))

    rows = [("r", "own", "/w", "text", 5), ("r", "flake8", "/w", "a.py:1:2: E1 m", 6), ("r", "other", "/w", "x", 7)]
    frame = spark.createDataFrame(rows, REPORTS + ", report_pos int")
    found = lint_reports.normalize_lint_reports(frame, {**lint_reports.FORMATS, "own": lines}).collect()
    assert sorted((r["repo_id"], r["linter"], r["message"], r["report_pos"]) for r in found) == [
        ("r", "flake8", "m", 6), ("r", "own", "text", 5)]
    assert lint_reports.normalize_lint_reports(frame.drop("report_pos"), {"own": lines}).count() == 1


def test_attributes_are_read_in_one_pass(spark):
    """Names whole, the last value of a repeated one, and values that look like attributes."""
    from pyspark.sql import functions as F

    from reviewloom.operators import lint_reports as L

    tag = '<error xid="no" id="a" msg="say id=" line="7" id="b" line="08" col=\'1\' empty=""/>'
    a = L._attributes(F.lit(tag))
    row = spark.range(1).select(
        L._attribute(a, "id"), L._attribute(a, "msg"), L._number_or_one(L._attribute(a, "line")), L._attribute(a, "empty"),
        L._attribute(a, "col"), L._attribute(a, "i"), L._number_or_one(L._attribute(a, "col")),
    ).first()
    assert tuple(row) == ("b", "say id=", 8, "", None, None, 1)


def test_a_location_and_a_file_name_are_looked_up_once(spark):
    """Pieces and segments carry what their tags share; before, every tag searched for it again."""
    from pyspark.sql import functions as F

    from reviewloom.operators import lint_reports as L

    text = '<error id="a" msg="x"/><error id="b" msg="y"/><location file="/r/z.h" line="3" col="0"/><error id="c" msg="w" file="own.c"/>'
    payload = spark.createDataFrame([(text, "/r//")], "payload string, root string")
    found = payload.select(F.explode(L.cppcheck(F.col("payload"), F.col("root"))).alias("f")).select("f.*")
    assert [(r["file"], r["line"], r["column"], r["rule_id"]) for r in found.collect()] == [
        ("z.h", 3, 1, "cppcheck/a"), ("z.h", 3, 1, "cppcheck/b"), ("own.c", 1, 1, "cppcheck/c")]
    plan = payload.select(L.cppcheck(F.col("payload"), F.col("root")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 3
