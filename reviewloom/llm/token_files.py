"""Token ids as Arrow IPC files of fixed-size lists.

Documents are laid out in ascending ``doc_id`` order (rows of one id by text, null ids first).
Each shard is two files: ``tokens-<k>.arrow`` holds the ids of its documents cut into equal
sequences, with a mask that is false on the padding of the last one, and ``docs-<k>.arrow`` tells
where each document begins. Both columns of the first are fixed-size lists, of plain integers
and of bits, so a memory-mapped shard gives any sequence and its mask without a copy
(``open_shard``).

A shard is written under a temporary name and renamed, and its content depends on its rows
only, so a repeated or speculative task writes the same file again, or leaves the one that is
there where a rename does not replace. A folder without a scheme is on Spark's default file
system, never on the disk of an executor. A task holds 64 sequences and the ids of one Arrow
batch, so a very long text is encoded whole and written in pieces.

Null or empty texts have only the end id. An empty table gives no shards and no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewloom.llm.store import prepared, scratch_dir
from reviewloom.session import qualified

END_ID = 2
SEQUENCE = 2048
#: Characters of chunks whose ids a task remembers, and how many chunks.
_CHUNK_CHARS, _MEMO = 48, 500_000
_ROWS_PER_SEQUENCE_BATCH = 64
_RARE_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Below it, what counts as a letter or a number is the same in every Unicode version in use.
_PLAIN = re.compile("[\\0-\u024f]*").fullmatch
_PIECES = regex.compile(public_tokenizers.PATTERN)
#: Byte-level vocabularies spell unprintable bytes with the letters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {
    b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))
}

_SHARD = "shard int, first_id bigint, n_docs bigint, n_tokens bigint"
_DOC = "shard int, doc_at bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts, with the ids of frequent chunks remembered.

    The split pattern of the byte-level vocabulary puts a space with the word after it and
    never joins a visible character with a following space. A text may hence be cut before
    each space that stands between visible characters without changing its ids. Chunks of
    Latin letters are split by the published pattern and merged by the vocabulary's model;
    all others, and texts with a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = _tokenizer(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype(np.uint32 if wide else np.uint16)
        self.byte_level = type(self.tokenizer.model).__name__ == "BPE" and (
            type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel") and (
            not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None)
        self.after_space = _Chunks(self._chunk)
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype).tobytes()

    def _merged(self, piece: str) -> bytes:
        if piece.isascii() and piece[-1].isalnum():
            spelled = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            spelled = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return array(self.dtype.char, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not self.byte_level or not chunk or not _PLAIN(chunk):
            return self._whole(chunk)
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._merged(chunk)
        known, out = self.pieces, []
        for piece in _PIECES.findall(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = self._merged(piece)
                if len(known) < _MEMO and len(piece) <= _CHUNK_CHARS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        if "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or any(
            blank in text for blank in _RARE_BLANKS
        ):
            head, *rest = _CUT.split(text)
        else:
            head, *rest = text.split(" ")
            if not head and rest:
                head, rest = " " + rest[0], rest[1:]
        return b"".join((self._chunk(head), *map(self.after_space.__getitem__, rest)))


class _Chunks(dict):
    """Ids of chunks by their text without the space before it; the first many are kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(" " + text)
        if len(self) < _MEMO and len(text) <= _CHUNK_CHARS:
            self[text] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _rename(system: fs.FileSystem, part: str, name: str) -> None:
    """Gives a finished file its name; where one is there already and stays, it is the same."""
    try:
        system.move(part, name)
    except OSError:
        if system.get_file_info(name).type != fs.FileType.File:
            raise
        system.delete_file(part)


class ShardWriter:
    """Writes the files of one shard, a bounded number of sequences at a time."""

    def __init__(self, folder: str, shard: int, length: int, dtype: np.dtype):
        self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.names = [f"{base}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "docs")]
        self.parts = [f"{name}.{uuid.uuid4().hex}.tmp" for name in self.names]
        kind = pa.from_numpy_dtype(dtype)
        self.length, self.dtype = length, dtype
        self.schemas = [
            pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]),
            pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
        ]
        self.sinks = [self.system.open_output_stream(p) for p in self.parts]
        self.files = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, self.schemas)]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.record_batch(
            [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.schemas[1]))
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(ids)
        self.held += ids
        self.n_held += int(sizes.sum())
        if self.n_held >= self.length * _ROWS_PER_SEQUENCE_BATCH:
            self._flush(False)

    def _flush(self, final: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.length * _ROWS_PER_SEQUENCE_BATCH
        for at in range(0, len(flat), step):
            piece = flat[at : at + step]
            if len(piece) < step and not final:
                break
            padded = np.zeros(-(-len(piece) // self.length) * self.length, dtype=self.dtype)
            padded[: len(piece)] = piece
            mask = np.arange(len(padded)) < len(piece)
            self.files[0].write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)],
                schema=self.schemas[0]))
        rest = 0 if final else len(flat) % step
        self.held = [flat[len(flat) - rest :].copy()] if rest else []
        self.n_held = rest

    def close(self) -> None:
        self._flush(True)
        for file, sink, part, name in zip(self.files, self.sinks, self.parts, self.names):
            file.close()
            sink.close()
            _rename(self.system, part, name)


def open_shard(path: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The batches of a shard on a local disk: ids as a (sequences, length) view of the mapped
    file, and the mask, whose bits stay where they are."""
    file = pa.ipc.open_file(pa.memory_map(path))
    for k in range(file.num_record_batches):
        ids, mask = file.get_batch(k).columns
        yield ids.flatten().to_numpy(zero_copy_only=True).reshape(len(ids), -1), mask


def write_tokens(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID,
    length: int = SEQUENCE, shards: int | None = None,
) -> DataFrame:
    """Encode ``(doc_id, text)`` into files below ``folder``; one row per shard.

    ``shards`` is the number of range partitions of ``doc_id``; by default that of shuffles.
    """
    spark = prepared(documents.sparkSession, 256)
    folder = qualified(spark, folder)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, shard = _encoder(tokenizer_path), None, TaskContext.get().partitionId()
        first = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            if writer is None:
                writer, first = ShardWriter(folder, shard, length, encoder.dtype), ids[0]
            tail = np.array([end_id], dtype=encoder.dtype).tobytes()
            coded = [encoder(t or "") + tail for t in texts]
            writer.add(ids, [np.frombuffer(x, dtype=encoder.dtype) for x in coded])
        if writer is not None:
            writer.close()
            row = {"shard": shard, "first_id": first, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("shard", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()),
                ("n_tokens", pa.int64())]))

    ordered = (
        documents.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    )
    path = scratch_dir(spark, "shards")
    ordered.mapInArrow(encode, _SHARD).write.parquet(path)
    return spark.read.schema(_SHARD).parquet(path)


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: its id, global start, number of ids and their CRC-32."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("shard", pa.int32()), ("doc_at", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
            ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("shard_start").to_pylist()):
                yield from _shard_documents(path, start, schema)

    folder = qualified(spark, folder)
    # Names and offsets travel through Spark, one small row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    names = manifest.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"),
        F.concat(F.lit(f"{folder.rstrip('/')}/"), F.lit("{}-"), F.format_string("%06d", "shard"),
                 F.lit(".arrow")).alias("path"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartitionById(tasks, F.col("shard") % tasks).mapInArrow(parse, _DOC)


def _shard_documents(path: str, shard_start: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    system, token_path = fs.FileSystem.from_uri(path.replace("{}", "tokens"))
    _, doc_path = fs.FileSystem.from_uri(path.replace("{}", "docs"))
    shard = int(path.rsplit("-", 1)[1].split(".")[0])
    with system.open_input_file(token_path) as token_source, system.open_input_file(doc_path) as doc_source:
        tokens, docs = pa.ipc.open_file(token_source), pa.ipc.open_file(doc_source)
        held, at, next_batch, seen = np.zeros(0, np.uint32), 0, 0, 0
        for k in range(docs.num_record_batches):
            batch = docs.get_batch(k)
            starts, sizes = batch.column("start").to_numpy(), batch.column("n_tokens").to_numpy()
            sums = []
            for start, size in zip(starts.tolist(), sizes.tolist()):
                parts = [held[start - at :]]
                have = len(parts[0])
                while have < size:
                    piece = tokens.get_batch(next_batch)
                    ids = piece.column("ids").flatten().to_numpy()
                    kept = piece.column("mask").flatten().to_numpy(zero_copy_only=False)
                    parts.append(ids[kept].astype("<u4"))
                    have += len(parts[-1])
                    next_batch += 1
                held, at = np.concatenate(parts), start
                sums.append(zlib.crc32(held[:size].tobytes()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(batch), shard, np.int32)),
                pa.array(np.arange(seen, seen + len(batch))), batch.column("doc_id"),
                pa.array(starts + shard_start), batch.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)
            seen += len(batch)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "token-files")
    manifest = write_tokens(documents, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
