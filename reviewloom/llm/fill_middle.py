"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as an archive: independent zstandard frames of at most ``FRAME_UNITS`` code
points, each with the number of code points before it. Two cut points are drawn from the
document id. Reading a range decompresses only frames that it overlaps, so cutting opens the
one or two frames that hold the cuts; all other frames go into the output archive as they
are. Digests stream the frames in order and hold one of them at a time.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix
``<P>`` prefix ``<M>`` middle, ``plain`` the text itself: for empty texts, texts that hold one
of the marks, and the share of documents that is not transformed.

Defined results: a null text is the empty text; a null id is drawn like the text ``null``;
repeated rows are transformed each; a long text is many frames of one row, read one at a
time; an empty table gives an empty table. ``archived`` keeps all columns but ``text``;
columns of the input that bear a name it adds (``frames``, ``units``, ``marked``, and for
``fill_in_middle`` also ``form``, ``prefix_chars``, ``middle_chars``), in any case, are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.llm.store import prepared, set_aside, staged

SEED = 1
FRAME_UNITS = 65_536
LEVEL = 3
#: Shares of 100: documents that are transformed, and of those the ones in the form spm.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

_FRAMES = "array<struct<first: bigint, units: int, data: binary>>"
_FRAMES_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("units", pa.int32()), ("data", pa.binary())]))
_ADDED = ("frames", "units", "marked", "form", "prefix_chars", "middle_chars")


class Writer:
    """Collects frames and counts the units before each."""

    def __init__(self):
        self.frames: list[dict] = []
        self.units = 0
        self._compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress

    def text(self, text: str) -> None:
        for at in range(0, len(text), FRAME_UNITS):
            piece = text[at : at + FRAME_UNITS]
            self.stored(len(piece), self._compress(piece.encode()))

    def stored(self, units: int, data: bytes) -> None:
        self.frames.append({"first": self.units, "units": units, "data": data})
        self.units += units


class Reader:
    """Random access to the frames of one text by code points."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.opened = 0
        self._decompress = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return self.frames[-1]["first"] + self.frames[-1]["units"] if self.frames else 0

    def _overlapping(self, start: int, stop: int) -> Iterator[tuple[dict, int, int]]:
        low, high = 0, len(self.frames)
        while low < high:  # the first frame that ends after the start
            mid = (low + high) // 2
            if self.frames[mid]["first"] + self.frames[mid]["units"] <= start:
                low = mid + 1
            else:
                high = mid
        for frame in self.frames[low:]:
            if frame["first"] >= stop:
                return
            yield frame, max(0, start - frame["first"]), min(frame["units"], stop - frame["first"])

    def _open(self, frame: dict) -> str:
        self.opened += 1
        return self._decompress(frame["data"]).decode()

    def read(self, start: int, stop: int) -> Iterator[str]:
        """The units ``start`` to ``stop``, frame by frame."""
        for frame, a, b in self._overlapping(start, stop):
            yield self._open(frame)[a:b]

    def copy(self, start: int, stop: int, into: Writer) -> None:
        """Append the same units to another archive; whole frames are not opened."""
        for frame, a, b in self._overlapping(start, stop):
            if b - a == frame["units"]:
                into.stored(frame["units"], frame["data"])
            elif a < b:
                into.text(self._open(frame)[a:b])

    def find(self, mark: str, start: int) -> int:
        """First place of ``mark`` at or after ``start``, over frame borders; -1 without one."""
        tail, at = "", start
        for piece in self.read(start, len(self)):
            joined = tail + piece
            found = joined.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = joined[-(len(mark) - 1):]
        return -1


def cut_points(doc_id, units: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Ends of prefix and middle, and the two numbers that decide the form."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    ends = sorted((h1 % (units + 1), h2 % (units + 1)))
    return ends[0], ends[1], h3, h4


def arranged(doc_id, frames: list[dict], marked: bool, seed: int = SEED):
    """``(form, prefix, middle, frames)`` of one document."""
    source = Reader(frames)
    units = len(source)
    a, b, h3, h4 = cut_points(doc_id, units, seed)
    if not units or marked or h3 % 100 >= TRANSFORMED:
        return "plain", None, None, frames
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    parts = {PREFIX: (0, a), SUFFIX: (b, units), MIDDLE: (a, b)}
    out = Writer()
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        out.text(mark)
        source.copy(*parts[mark], out)
    return form, a, b - a, out.frames


def restored(frames: list[dict], form: str) -> Iterator[str]:
    """The text that an output was made from, in pieces; found by the marks in the output alone."""
    source = Reader(frames)
    size = len(source)
    if form == "plain":
        yield from source.read(0, size)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    starts, at = [], 0
    for mark in order:
        at = source.find(mark, at)
        if at < 0:
            raise ValueError(f"output of form {form} without {mark}")
        at += len(mark)
        starts.append(at)
    ends = [start - len(mark) for start, mark in zip(starts[1:], order[1:])] + [size]
    ranges = dict(zip(order, zip(starts, ends)))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from source.read(*ranges[mark])


def _digest(pieces: Iterator[str]) -> str:
    state = hashlib.sha256()
    for piece in pieces:
        state.update(piece.encode())
    return state.hexdigest()


def _mapped(
    frame: DataFrame, needed: tuple[str, ...], added: dict[str, str], types: list[pa.DataType], row: Callable,
) -> DataFrame:
    """``frame`` with further columns: for each row what ``row(batch, k)`` makes of the ``needed`` ones."""
    source, rest = set_aside(frame, *needed)
    out = source.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()])
    n = len(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(batch, k) for k in range(batch.num_rows)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n], *made], names=batch.schema.names)

    return out.mapInArrow(run, out.schema).select(*needed, *rest, *added)


def _without(frame: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of ``frame`` but for those that bear one of the names in any case."""
    return [F.col(f"`{c}`") for c in frame.columns if c.lower() not in names]


def archived(documents: DataFrame) -> DataFrame:
    """The documents with ``frames``, ``units`` and ``marked`` in place of ``text``.

    ``marked`` says that the text holds one of the marks.
    """
    prepared(documents.sparkSession)
    source = documents.select(*_without(documents, (*_ADDED, "text")), F.col("text").alias("text"))

    def row(batch: pa.RecordBatch, k: int):
        text = batch.column("text")[k].as_py() or ""
        out = Writer()
        out.text(text)
        return out.frames, out.units, any(mark in text for mark in MARKS)

    added = {"frames": _FRAMES, "units": "bigint", "marked": "boolean"}
    return _mapped(source, ("text",), added, [_FRAMES_TYPE, pa.int64(), pa.bool_()], row).drop("text")


def _frames(batch: pa.RecordBatch, k: int) -> list[dict]:
    return batch.column("frames")[k].as_py() or []


def fill_in_middle(archive: DataFrame, seed: int = SEED) -> DataFrame:
    """An archive of the same columns whose ``frames`` hold the outputs, with ``form``,
    ``prefix_chars`` and ``middle_chars``; ``units`` stays that of the text."""
    ids = archive.select("doc_id", *_without(archive, (*_ADDED[3:], "doc_id")))

    def row(batch: pa.RecordBatch, k: int):
        form, a, b, out = arranged(
            batch.column("doc_id")[k].as_py(), _frames(batch, k), batch.column("marked")[k].as_py(), seed)
        return out, form, a, b

    added = {"__output": _FRAMES, "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}
    made = _mapped(ids, ("doc_id", "frames", "marked"), added, [_FRAMES_TYPE, pa.string(), pa.int64(), pa.int64()], row)
    return made.drop("frames").withColumnRenamed("__output", "frames")


def with_digests(outputs: DataFrame) -> DataFrame:
    """``output_sha256`` of the output and ``restored_sha256`` of the text rebuilt from it."""
    added = {"output_sha256": "string", "restored_sha256": "string"}

    def row(batch: pa.RecordBatch, k: int):
        frames, form = _frames(batch, k), batch.column("form")[k].as_py()
        source = Reader(frames)
        return _digest(source.read(0, len(source))), _digest(restored(frames, form))

    source = outputs.select(*_without(outputs, tuple(added)))
    return _mapped(source, ("frames", "form"), added, [pa.string(), pa.string()], row)


def with_text(outputs: DataFrame, into: str = "text") -> DataFrame:
    """The texts that the frames hold, as a plain column."""

    def row(batch: pa.RecordBatch, k: int):
        source = Reader(_frames(batch, k))
        return ("".join(source.read(0, len(source))),)

    source = outputs.select(*_without(outputs, (into.lower(),)))
    return _mapped(source, ("frames",), {into: "string"}, [pa.string()], row)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's output."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    outputs = fill_in_middle(staged(archived(documents), "frames"))
    return with_digests(outputs).select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256",
        "restored_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents
), h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3,
    CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
