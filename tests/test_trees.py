"""Source trees: what is opened, how deep, and reading what was listed."""

import os

import pytest

from reviewloom.sources import trees


def _write(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


def _names(frame):
    return sorted(f"{r['repo_id']}/{r['path']}" for r in frame.collect())


def test_ignored_directories_are_not_opened(spark, tmp_path):
    _write(tmp_path, "r/src/a.js", "r/src/b.png", "r/node_modules/x/c.js", "r/.git/d.js", "r/src/.e.js",
           "node_modules/f.js", "r/src/g.min.js", "top.js")
    # A name that is not UTF-8 fails any listing of its directory.
    bad = os.path.join(os.fsencode(tmp_path), b"r/node_modules/\xff\xfe.js")
    open(bad, "w").close()
    assert _names(trees.list_source_tree(spark, str(tmp_path), extensions=[".js"])) == ["node_modules/f.js", "r/src/a.js"]
    assert _names(trees.list_source_tree(spark, str(tmp_path))) == ["node_modules/f.js", "r/src/a.js", "r/src/b.png"]
    os.rename(bad, os.path.join(os.fsencode(tmp_path), b"r/src/\xff\xfe.js"))
    with pytest.raises(Exception):
        trees.list_source_tree(spark, str(tmp_path)).collect()


def test_depth_links_and_deeper_repositories(spark, tmp_path):
    deep = "/".join(["d"] * 20)
    _write(tmp_path, f"o/r/{deep}/a.py", f"o/r/{deep}/d/b.py", "o/c.py")
    os.symlink(tmp_path / "o", tmp_path / "o/r/loop")
    assert _names(trees.list_source_tree(spark, str(tmp_path), 2)) == [f"o/r/{deep}/a.py"]
    assert len(_names(trees.list_source_tree(spark, str(tmp_path), 2, max_depth=None))) == 2
    assert _names(trees.list_source_tree(spark, str(tmp_path), 2, max_depth=0)) == []
    assert _names(trees.list_source_tree(spark, f"{tmp_path}/none")) == []


def test_only_listed_files_are_read(spark, tmp_path):
    rows = [("r", "a b+%41.js", "é\r\n\0x"), ("r", "c.js", ""), ("r", "d.js.gz", "plain"), ("r", "e.png", None)]
    trees.write_source_tree(spark.createDataFrame(rows, "repo_id string, path string, content string"), str(tmp_path))
    listing = trees.list_source_tree(spark, str(tmp_path), extensions=[".js", ".gz"])
    os.remove(tmp_path / "r/e.png")
    read = trees.with_contents(listing, str(tmp_path))
    assert sorted((r["path"], r["content"]) for r in read.collect()) == [(p, c) for _, p, c in rows[:3]]
    os.remove(tmp_path / "r/c.js")
    with pytest.raises(Exception, match="c.js"):
        read.collect()


def test_a_path_may_not_leave_its_repository(spark, tmp_path):
    rows = spark.createDataFrame([("r", "../x.js", "t")], "repo_id string, path string, content string")
    with pytest.raises(Exception, match="outside its repository"):
        trees.write_source_tree(rows, str(tmp_path))
