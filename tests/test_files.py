"""Walks, detection, plans and scans on literal repositories."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import files as fl
from reviewloom.operators import languages as lang
from reviewloom.operators import scan
from reviewloom.sources import tables


def repo(spark, contents, name="r"):
    return spark.createDataFrame(
        [(name, path, text) for path, text in contents.items()],
        "repo_id string, path string, content string",
    )


def paths(frame):
    return sorted(r["path"] for r in frame.collect())


def test_walker(spark):
    files = repo(spark, {"src/app.js": "x", "src/util.ts": "x", "node_modules/lodash.js": "x",
                         "image.png": "x", ".env.js": "x", "a.min.js": "x"})
    listing = fl.source_files(files)
    assert paths(listing) == ["src/app.js", "src/util.ts"]
    stats = fl.scan_stats(listing).collect()[0]
    assert (stats["total_files"], stats["stopped_early"], stats["warning"]) == (2, False, None)


def test_depth_limit(spark):
    kept = "/".join(["d"] * 20 + ["a.py"])
    dropped = "/".join(["d"] * 21 + ["b.py"])
    files = repo(spark, {kept: "", dropped: ""})
    assert paths(fl.source_files(files)) == [kept]
    manifests = repo(spark, {dropped.replace("b.py", "go.mod"): "", "d/" + dropped.replace("b.py", "go.mod"): ""})
    assert fl.manifest_directories(manifests, "go.mod").count() == 1


def test_cap_is_exact_for_a_hot_repository(spark):
    hot = spark.range(6000).select(
        F.lit("hot").alias("repo_id"), F.format_string("f%05d.py", "id").alias("path"),
        F.lit("c").alias("content"))
    files = hot.unionByName(repo(spark, {"a.py": "", "b.py": ""}))
    listing = fl.source_files(files)
    counts = {r["repo_id"]: r["count"] for r in listing.groupBy("repo_id").count().collect()}
    assert counts == {"hot": 5000, "r": 2}
    assert listing.where("repo_id = 'hot'").agg(F.max("path")).collect()[0][0] == "f04999.py"
    assert fl.walk(files, [".py"]).count() == 6002
    assert fl.walk_with_content(files, [".py"]).count() == 6002
    with_text = fl.walk_with_content(files, [".py"], 5000)
    assert with_text.select("repo_id", "path").exceptAll(listing).count() == 0
    assert with_text.count() == 5002


def test_detection(spark):
    files = repo(spark, {"src/app.js": "", "server.py": "", "package.json": "{}"})
    found = [r["language"] for r in lang.detect_languages(files).orderBy("registry_pos").collect()]
    assert found == ["javascript", "python", "mongodb"]


def test_manifest_quirks(spark):
    def languages(contents):
        return {r["language"] for r in lang.detect_languages(repo(spark, contents)).collect()}

    assert languages({"sub/.rubocop.yml": ""}) == {"ruby"}
    assert languages({"Makefile/notes.txt": ""}) == {"cpp"}
    assert languages({"vendor/go.mod": ""}) == set()
    assert languages({"sub/Makefile/notes.txt": ""}) == set()
    assert languages({"package.json": ""}) == {"javascript", "mongodb"}


def test_plan_flags_and_plugin(spark):
    detections = lang.detect_languages(repo(spark, {"a.js": "", "b.py": ""}))
    plan = lang.linter_plan(detections, lang.registry_table(spark), {"runPython": False})
    assert {r["linter"] for r in plan.collect()} == {"eslint", "mongodb-analyzer"}
    extended = (*lang.REGISTRY, ("lua", "luacheck", "runLua", (".lua",), ()))
    found = lang.detect_languages(repo(spark, {"x.lua": ""}), extended)
    plan = lang.linter_plan(found, lang.registry_table(spark, extended))
    assert [r["linter"] for r in plan.collect()] == ["luacheck"]


def test_dialects(spark):
    def dialect(contents):
        return lang.sql_dialects(repo(spark, contents)).collect()[0]["dialect"]

    assert dialect({"package.json": '{"devDependencies":{"pg-promise":"1"}}'}) == "postgres"
    assert dialect({"package.json": "{", "requirements.txt": "asyncpg==1"}) == "postgres"
    assert dialect({"db/a.psql": ""}) == "postgres"
    assert dialect({"node_modules/a.psql": "", "sub/requirements.txt": "psycopg"}) == "ansi"


def test_lines_keep_trailing_blank_and_returns(spark):
    lines = scan.explode_lines(repo(spark, {"a": "x\r\ny\n"})).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in lines] == [(1, "x\r"), (2, "y"), (3, "")]


def test_database_rules(spark):
    code = "\n".join([
        "import mongoose from 'mongoose'",
        "  // db.x.drop()",
        "db.x.drop(); y.drop()",
        "q({$where: 'x'}); X.find({}).lean()",
        "new ObjectId()  u.updateMany({}",
    ])
    found = scan.analyze_database_usage(repo(spark, {"a.js": code, "b.js": "db.x.drop()"}))
    got = sorted((r["line"], r["column"], r["rule_id"].split("/")[1]) for r in found.collect())
    assert got == [(3, 5, "no-collection-drop"), (4, 4, "no-where-operator"), (4, 20, "no-empty-filter"),
                   (5, 1, "objectid-no-empty"), (5, 18, "no-empty-bulk-filter")]


def test_lookahead(spark):
    def flagged(*lines):
        return [r["line_no"] for r in scan.scan_lookahead(repo(spark, {"a.js": "\n".join(lines)})).collect()]

    assert flagged("User.find({a}).lean()") == []
    assert flagged("User.find({a})", "", "", "", ".lean()") == []
    assert flagged("User.find({a})", "", "", "", "", ".lean()") == [1]
    assert flagged("User.findOne({a})", ".lean", "()") == []
    assert flagged("arr.find(x)", "  // User.find(x)") == []


def test_secrets(spark):
    token, key = "ghp_" + "a1B2" * 9, "AKIA" + "ABCD1234" * 2
    files = repo(spark, {
        "config.js": f'// c\nconst h = "localhost";\nconst T = "{token}";\nconst K = "{key}";\n'
                     'const api_key = "abcdefghij0123456789";\nmodule.exports = {};',
        "README.md": f'api_key="{token}"', ".env.example": f"K={key}", "index.js": "const name = 'x';",
        "sub/.env": "A=1",
    })
    found = scan.scan_secrets(files)
    got = {(r["path"], r["line"], r["pattern_id"]) for r in found.collect()}
    assert got == {("config.js", 3, "github_pat"), ("config.js", 4, "aws_access_key_id"),
                   ("config.js", 5, "generic_api_key_assignment"), ("sub/.env", 1, "env_file_committed")}
    assert all("***REDACTED***" in r["match_preview"] and token not in r["match_preview"]
               for r in found.collect())
    stats = scan.secret_scan_stats(files, found).collect()[0]
    assert (stats["scanned_files"], stats["skipped_files"], stats["findings_count"]) == (3, 2, 4)
    gate = scan.secret_gate(found)
    assert gate.collect()[0]["code"] == "SECRETS_FOUND"
    other = files.unionByName(repo(spark, {"ok.js": ""}, "clean"))
    assert paths(scan.without_blocked(other, gate)) == ["ok.js"]


def test_source_tree_reader(spark, tmp_path):
    for path, text in {"one/src/a b.py": "x = 1\n", "one/+c.py": "", "two/z.rs": "fn"}.items():
        target = tmp_path / "checkouts" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    rows = tables.read_source_tree(spark, str(tmp_path / "checkouts")).collect()
    got = {(r["repo_id"], r["path"]): r["content"] for r in rows}
    assert got[("one", "src/a b.py")] == "x = 1\n" and got[("two", "z.rs")] == "fn"
    assert len(got) in (2, 3)  # an empty file may give no row


def test_lint_report_files(spark, tmp_path):
    target = tmp_path / "reports" / "flake8" / "one.txt"
    target.parent.mkdir(parents=True)
    target.write_text("./a.py:1:1: E1 m\n")
    row = tables.read_lint_report_files(spark, str(tmp_path / "reports"), "/w/").collect()[0]
    assert (row["repo_id"], row["linter"], row["root"]) == ("one", "flake8", "/w/one")


@pytest.mark.parametrize("name", ["src", "c++", "a b", "100%", "x[1]"])
def test_source_tree_root_is_a_plain_prefix(spark, tmp_path, name):
    root = tmp_path / name / "b" / name
    (root / "repo1" / "lib").mkdir(parents=True)
    (root / "repo1" / "lib" / "a.py").write_text("x")
    (root / "repo 2+%").mkdir()
    (root / "repo 2+%" / "b c.py").write_text("y")
    rows = tables.read_source_tree(spark, str(root)).collect()
    assert {tuple(r) for r in rows} == {("repo1", "lib/a.py", "x"), ("repo 2+%", "b c.py", "y")}


def test_lint_report_files_decode_their_names(spark, tmp_path):
    folder = tmp_path / "reports" / "eslint"
    folder.mkdir(parents=True)
    (folder / "my repo.json").write_text("[]")
    row = tables.read_lint_report_files(spark, str(tmp_path / "reports"), "/w/").collect()[0]
    assert (row["repo_id"], row["linter"], row["root"]) == ("my repo", "eslint", "/w/my repo")


def test_every_secret_of_a_line_is_found(spark):
    keys = "AKIA" + "A" * 16, "AKIA" + "B" * 16
    files = spark.createDataFrame([("r", "a.js", f"x {keys[0]} y {keys[1]}\nz {keys[0]}")], "repo_id string, path string, content string")
    rows = scan.scan_secrets(files).collect()
    assert sorted(r["line"] for r in rows) == [1, 1, 2]
