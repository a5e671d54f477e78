"""Source trees listed level by level, so that ignored directories are never opened.

Every level of directories is one Spark job whose tasks list a share of them: a large repository
is spread over many tasks, and the driver never holds a listing. Ignored, hidden and too deep
directories are not listed at all; file names are filtered by the same column predicates as any
other listing. Contents are read by a step of their own, from what is left of the listing then.

Works on every file system that ``pyarrow.fs`` can open by its scheme. Links to directories are
not followed on local file systems, so a walk ends.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import paths as P
from reviewloom.operators.files import walkable
from reviewloom.session import qualified, scratch_dir

_ENTRY = "place string, bytes bigint, is_directory boolean"
_ENTRY_ARROW = pa.schema([("place", pa.string()), ("bytes", pa.int64()), ("is_directory", pa.bool_())])
# Entries, or bytes of contents, that a task holds before it hands them on.
_ENTRIES, _CONTENT_BYTES = 4096, 8 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _entries(system: fs.FileSystem, base: str, directory: str, pruned) -> Iterator[tuple[str, int, bool]]:
    """Files and open subdirectories directly below ``directory``, named from the root on."""
    local = isinstance(system, fs.LocalFileSystem)
    for info in system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"), recursive=False)):
        place = f"{directory}/{info.base_name}" if directory else info.base_name
        if info.type == fs.FileType.File:
            yield place, info.size, False
        elif info.type == fs.FileType.Directory and not pruned(info.base_name) and not (
            local and os.path.islink(info.path)
        ):
            yield place, 0, True


def _listed(directories: DataFrame, root: str, pruned) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        held: list[tuple[str, int, bool]] = []
        for batch in batches:
            for directory in batch.column("place").to_pylist():
                for entry in _entries(system, base, directory, pruned):
                    held.append(entry)
                    if len(held) == _ENTRIES:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)

    return directories.select("place").mapInArrow(run, _ENTRY)


def _batch(entries: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), _ENTRY_ARROW)], schema=_ENTRY_ARROW)


def _never(name: str) -> bool:
    return False


def _pruning(skip_hidden: bool):
    ignored = frozenset(P.IGNORED_DIRECTORIES)
    return lambda name: name in ignored or (skip_hidden and name.startswith("."))


def list_source_tree(
    spark: SparkSession, root: str, repo_depth: int = 1, extensions: Sequence[str] | None = None,
    max_depth: int | None = P.MAX_DEPTH, skip_hidden: bool = True,
) -> DataFrame:
    """``repo_id, path, bytes`` of the files a walk visits; nothing ignored is opened.

    The first ``repo_depth`` directories below the root name the repository. An empty or missing
    root gives no rows; a directory that cannot be listed fails the job.
    """
    root = qualified(spark, root)
    system, base = _opened(root)
    folder, level = scratch_dir(spark, "tree"), 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = spark.createDataFrame([], "repo_id string, path string, bytes bigint")
    if system.get_file_info(base or "/").type != fs.FileType.Directory:
        return none
    frontier = spark.createDataFrame([("",)], "place string")
    pruned = _pruning(skip_hidden)
    while max_depth is None or level <= repo_depth + max_depth:
        _listed(frontier, root, pruned if level >= repo_depth else _never).write.parquet(f"{folder}/level={level}")
        found = spark.read.schema(_ENTRY).parquet(f"{folder}/level={level}").where("is_directory")
        if found.isEmpty():
            break
        frontier, level = found.repartition(tasks, "place"), level + 1
    listed = (
        spark.read.schema(_ENTRY + ", level int").parquet(folder)
        .where(~F.col("is_directory") & (F.col("level") >= repo_depth))
    )
    repo = F.array_join(F.slice(F.split("place", "/"), 1, repo_depth), "/")
    rows = listed.select(
        repo.alias("repo_id"), F.substring(F.col("place"), F.length(repo) + 2, F.length("place")).alias("path"), "bytes"
    )
    return walkable(rows, extensions, max_depth, skip_hidden)


def with_contents(listing: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``repo_id, path, content`` of the listed files only; one that cannot be read fails the job.

    The names are dealt to ``tasks`` tasks (by default those of a shuffle) by their hash, so the
    files of one large directory are read by all. Bytes that are not UTF-8 become replacement
    characters.
    """
    spark = listing.sparkSession
    root = qualified(spark, root)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("content", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        held, size = [], 0
        for batch in batches:
            for repo, path in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist()):
                with system.open_input_stream(f"{base}/{repo}/{path}", compression=None) as source:
                    content = source.read()
                held.append((repo, path, content.decode("utf-8", "replace")))
                size += len(content)
                if size >= _CONTENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    dealt = listing.select("repo_id", "path").repartition(tasks, "repo_id", "path")
    return dealt.mapInArrow(run, "repo_id string, path string, content string")


def write_source_tree(files: DataFrame, root: str) -> None:
    """Unpack ``repo_id, path, content`` as ``<root>/<repo_id>/<path>``; null contents are empty files.

    A file is written under another name and renamed, so a repeated task leaves the same file.
    Paths must lie below their repository.
    """
    root = qualified(files.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        made, written = set(), 0
        for batch in batches:
            for repo, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "content"))):
                if ".." in f"{repo}/{path}".split("/"):
                    raise ValueError(f"path outside its repository: {repo}/{path}")
                target = f"{base}/{repo}/{path}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part, compression=None) as sink:
                    sink.write((content or "").encode())
                system.move(part, target)
                written += 1
        yield pa.RecordBatch.from_pydict({"written": [written]})

    files.select("repo_id", "path", "content").mapInArrow(run, "written bigint").agg(F.sum("written")).collect()
