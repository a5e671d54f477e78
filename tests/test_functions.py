"""Literal edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import json_values as J
from reviewloom.functions import paths as P
from reviewloom.functions import severity as S
from reviewloom.functions import text as X
from reviewloom.functions import urls as U


def column(spark, values, expression, ddl="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    rows = frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_severity_words(spark):
    words = ["ERROR", "e", "critical", "Fatal", "Warn", "w", "style", "performance", "portability",
             "2", None, "note", "help", "convention", "refactor", "information"]
    assert column(spark, words, S.normalize_severity) == (
        ["error"] * 4 + ["warning"] * 5 + ["info"] * 7
    )
    assert column(spark, [2, 1, 0, None], S.normalize_severity_number, "int") == [
        "error", "warning", "info", "info"
    ]


def test_rank_weight_and_bands(spark):
    words = ["error", "warning", "info", "odd", None]
    assert column(spark, words, S.severity_rank) == [0, 1, 2, 3, 3]
    assert column(spark, words, S.severity_weight) == [3, 1, 0, None, None]
    assert column(spark, [90, 89, 70, 50, 30, 29], S.score_band, "int") == [
        "Excellent", "Good", "Good", "Fair", "Poor", "Critical"
    ]
    assert column(spark, [70, 69, 49], S.score_tone, "int") == ["ok", "warn", "error"]


def test_score_clamp(spark):
    assert column(spark, [72.5, 140.0, -3.0, None, 0.49], S.clamp_score, "double") == [
        73, 100, 0, 50, 0
    ]


def test_issue_key(spark):
    frame = spark.createDataFrame(
        [("a.js", 1, "lint", "m"), ("a.js", None, None, "m")],
        "file string, line int, category string, message string",
    )
    keys = [r[0] for r in frame.select(
        S.issue_key(F.col("file"), F.col("line"), F.col("category"), F.col("message"))
    ).collect()]
    assert keys == ["a.js::1::lint::m", "a.js::?::::m"]


def test_url_parses(spark):
    urls = ["https://github.com/o/r", "github.com/o/r.git", "https://github.com/o/r/tree/main",
            "https://github.com/o/r/", "https://github.com/orgs/x", "https://gist.github.com/o/1",
            "https://github.com/gistfan/x", "https://github.com/o", "", None,
            "  HTTPS://WWW.GitHub.com/o/r?x=1  ", "https://github.com/o/r#readme"]
    strict = [("o", "r", None)] * 4 + [
        (None, None, "INVALID_URL"), (None, None, "GIST_NOT_SUPPORTED"),
        (None, None, "GIST_NOT_SUPPORTED"), (None, None, "INVALID_URL"),
        (None, None, "INVALID_URL"), (None, None, "INVALID_URL"), ("o", "r", None), ("o", "r", None),
    ]
    got = column(spark, urls, lambda v: F.struct(
        U.strict_owner(v), U.strict_repo(v), U.url_error(v)))
    assert [tuple(g) for g in got] == strict
    tracked = column(spark, urls, U.tracked_repository)
    assert [t and (t["owner"], t["name"]) for t in tracked] == [
        ("o", "r"), ("o", "r"), None, ("o", "r"), ("orgs", "x"), None, ("gistfan", "x"), None, None,
        None, None, ("o", "r#readme"),
    ]
    assert tracked[1]["url"] == "https://github.com/o/r"
    assert column(spark, [None, "", "ftp://x", "http://github.com/a/b"], U.preflight_error) == [
        "MISSING_REPO_URL", "MISSING_REPO_URL", "INVALID_REPO_URL", None
    ]


def test_paths(spark):
    paths = ["a/b.min.js", "A.JS", ".eslintrc.js", "x/.git/y.js", "vendor/y.php", "src/vendors/y.php",
             "Makefile", "x.", "a/yarn.lock"]
    assert column(spark, paths, P.is_ignored_file) == [
        True, False, True, False, False, False, False, False, True
    ]
    assert column(spark, paths, P.in_ignored_directory) == [
        False, False, False, True, True, False, False, False, False
    ]
    assert column(spark, paths, P.extension) == [
        ".js", ".js", ".js", ".js", ".php", ".php", "", ".", ".lock"
    ]
    got = column(spark, ["/w/a/b.js", "a/b.js", "/other/x.js", "/w"],
                 lambda v: P.relative_path(F.lit("/w/"), v))
    assert got == ["a/b.js", "a/b.js", "/other/x.js", "/w"]
    assert column(spark, ["/w/a", "/other/x", "a"], lambda v: P.is_outside_root(F.lit("/w"), v)) == [
        False, True, False
    ]


def test_text(spark):
    assert column(spark, ["  x ﻿\n", "  "], X.trimmed) == ["x", ""]
    assert column(spark, ["\t// a", " * b", "#c", "x // d"], X.is_commented) == [
        True, True, True, False
    ]
    assert column(spark, ["&amp;lt;&lt;&#39;"], lambda v: X.unescape_xml(v, True)) == ["<<'"]
    assert column(spark, ["&#39;&quot;"], lambda v: X.unescape_xml(v, False)) == ["&#39;\""]
    assert column(spark, ["0", "7", "x", "", None], X.number_or_one) == [1, 7, 1, 1, 1]
    assert column(spark, [256, 348364, 307200], lambda v: X.megabytes(v, 1), "long") == [
        "0.3", "340.2", "300.0"
    ]
    assert column(spark, ["0123456789", "", None], X.short_sha) == ["0123456", None, None]
    assert column(spark, ["secretvalue"], X.redacted) == ["secret***REDACTED***"]


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1} x', '1},{"x":2', '1],[2', "1,2", '{"a":1,"a":2}', "", "null", " 7 ",
             '1,"~~ end of value ~~"', '"~~ end of value ~~"']
    got = column(spark, texts, lambda v: J.strict_json(v).cast("string"))
    assert got[:8] == ['{"a":1}', None, None, None, None, '{"a":2}', None, None]
    assert got[8:] == ["7", None, "~~ end of value ~~"]


def test_valid_json_too_large_for_a_variant_fails_the_job(spark, tmp_path):
    text = F.concat(F.lit('{"a":['), F.repeat(F.lit("[],"), 24_000_000), F.lit("[]]}"))
    frame = spark.range(2).withColumn("text", F.concat(text, F.when(F.col("id") == 1, " x").otherwise("")))
    frame.write.parquet(str(tmp_path / "answers"))
    answers = spark.read.parquet(str(tmp_path / "answers"))
    value = J.strict_json(F.col("text")).isNull()
    assert answers.where("id = 1").select(value).first()[0]
    with pytest.raises(Exception, match="larger than a variant"):
        answers.where("id = 0").select(value).collect()


def test_paths_without_scheme_are_on_the_default_file_system(spark):
    from reviewloom.session import qualified

    conf = spark._jsc.hadoopConfiguration()
    assert qualified(spark, "/a/b").startswith("file:/")
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./a", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert qualified(spark, "/a/b") == "viewfs://other/a/b"
        assert qualified(spark, "file:/a/b").startswith("file:/")
    finally:
        conf.set("fs.defaultFS", before)
