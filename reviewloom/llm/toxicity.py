"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on toxic text. A text is cut
into windows at sentence ends and, within long sentences, at blanks; each window is
compressed once with the ordinary dictionary and once with the toxic one put before it. How
many bytes the toxic one saves in each window, taken against several thresholds, gives the
features of a logistic calibration, fitted on labelled rows that the dictionaries have not
seen.

Most of a toxic document is ordinary, so its toxic dictionary is trained on telling words
alone: those that hold a sequence of ``GRAM`` bytes with the blanks around them, or are a whole
shorter word, in at least ``TELLING`` times as large a share of toxic as of ordinary windows. Phrases
of words that do not tell by themselves are not learned. Equal windows count once, so copies do
not weigh more.

The training sample is bounded: at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled rows
(the first in hash order of ``doc_id``). Of these rows the whole texts are learned, and all
documents are scored over their whole texts. Scores use nothing but the text.

Defined results: null texts count as empty; empty texts get the score of a text without
toxic windows; a document with several labels counts as toxic if one says so; without toxic
or without ordinary training rows every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.labels import fitted, remainder
from reviewloom.llm.store import prepared

MOST_TOXIC, MOST_ORDINARY = 1500, 4000
WINDOW, LEVEL, GRAM, TELLING = 48, 12, 6, 8
ORDINARY_BYTES, TOXIC_BYTES = 1 << 14, 1 << 12
_THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10)
_FOLDS = 5

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENDS = re.compile(rb"(?<=[.!?\n]) ?")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in lower case, cut into windows of at most ``size`` bytes."""
    out = []
    for piece in _ENDS.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        at = 0
        while at < len(piece):
            to = min(len(piece), at + size)
            if to < len(piece):
                blank = piece.rfind(b" ", at + size // 2, to)
                to = blank if blank > 0 else to
            out.append(piece[at:to])
            at = to
    return out


@dataclass(frozen=True)
class Model:
    """Dictionaries and the logistic calibration; ``prior`` alone if there is nothing to learn."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False)


def features(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    """Bytes saved per window: mean, largest, mean of the three largest, and shares and logarithms
    of counts above thresholds."""
    plain, marked = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress
    saved = np.array([len(plain(w)) - len(marked(w)) for w in windows(text)] or [0], dtype=np.float64)
    saved.sort()
    shares = [(saved > t).mean() for t in _THRESHOLDS]
    counts = [np.log1p((saved > t).sum()) for t in (3, 5, 8)]
    return [saved.mean(), saved[-1], saved[-3:].mean(), *shares, *counts]


def _short(word: bytes) -> int:
    """Key of a word too short for a sequence with the blanks around it; no sequence has it."""
    return len(word) << 56 | int.from_bytes(word, "big")


def _grams(piece: bytes) -> np.ndarray:
    """Byte sequences and short words of a piece."""
    flat = np.frombuffer(piece, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(flat) - GRAM + 1), np.uint64)
    for k in range(GRAM if len(out) else 0):
        out = (out << np.uint64(8)) | flat[k : len(flat) - GRAM + 1 + k]
    short = [_short(word) for word in set(piece.split(b" ")) if 0 < len(word) < GRAM - 2]
    return np.unique(np.concatenate([out, np.array(short, np.uint64)]))


def _counts(pieces: list[bytes], step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Byte sequences of all pieces and in how many they are, ``step`` pieces at a time."""
    found, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(pieces), step):
        more, n = np.unique(np.concatenate([_grams(b" " + p + b" ") for p in pieces[at : at + step]]), return_counts=True)
        found, place = np.unique(np.concatenate([found, more]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([times, n]), minlength=len(found)).astype(np.int64)
    return found, times


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _toxic_samples(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of toxic windows that are or hold what ordinary windows seldom have."""
    (marks, often), (usual, seldom) = _counts(toxic), _counts(ordinary)
    place = np.minimum(np.searchsorted(usual, marks), max(0, len(usual) - 1))
    there = np.where(usual[place] == marks, seldom[place], 0) if len(usual) else np.zeros(len(marks))
    telling = (often >= max(3, len(toxic) / 1000)) & (
        often / max(1, len(toxic)) >= TELLING * (there + 0.5) / max(1, len(ordinary)))
    chosen, known, samples = set(marks[telling].tolist()), {}, []
    for piece in toxic:
        hit = []
        for word in piece.split(b" "):
            if word not in known:
                known[word] = not chosen.isdisjoint(_grams(b" " + word + b" ").tolist())
            if known[word]:
                hit.append(word)
        if hit:
            samples.append(b" " + b" ".join(hit) + b" ")
    return [b"".join(samples[k : k + 4]) for k in range(0, len(samples), 4)]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + penalty * np.r_[w[:-1], 0]
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return mean, scale, w


def train(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from two thirds of the rows, calibration from the rest."""
    y = np.array(labels, dtype=np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    none = Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), prior)
    if not 0 < y.sum() < len(y):
        return none
    held = np.zeros(len(y), bool)
    for value in (0, 1):  # every third row of either label
        held[np.flatnonzero(y == value)[2::3]] = True
    if not (0 < y[held].sum() < held.sum()):
        held[:] = False
    toxic, ordinary = set(), set()
    for text, label, out in zip(texts, labels, held):
        if not out:
            (toxic if label else ordinary).update(windows(text, 256))
    toxic, ordinary = sorted(toxic - ordinary), sorted(ordinary)
    order = np.random.default_rng(0).permutation(len(ordinary))
    usual = _dictionary(ORDINARY_BYTES, [ordinary[k] for k in order])
    marked = _dictionary(TOXIC_BYTES, _toxic_samples(toxic, ordinary))
    if not marked:
        return none
    rows = np.flatnonzero(held) if held.any() else np.arange(len(y))
    x = np.array([features(texts[k], usual, marked) for k in rows])
    return Model(usual, marked, *_logistic(x, y[rows]), prior)


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of label 1 of each text."""
    if not len(model.weights) or not texts:
        return np.full(len(texts), model.prior)
    x = np.array([features(t, model.ordinary, model.toxic) for t in texts])
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, folds: int = _FOLDS) -> Model:
    """The model of the labelled rows outside fold 0."""
    prepared(documents.sparkSession)
    learns = remainder(F.col("doc_id"), folds) != 0
    return fitted(documents, labels, "toxic", learns, {1: MOST_TOXIC, 0: MOST_ORDINARY}, train)


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the score of each text; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = documents.drop(name).withColumn(name, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values, pa.float64())], names=batch.schema.names)

    return columns.mapInArrow(run, columns.schema)


def remove_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    packed = documents.select("text", F.struct(*[F.col(c) for c in documents.columns]).alias("doc"))
    kept = with_score(packed, model).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"doc.`{c}`") for c in documents.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(documents, model).select(
        "doc_id", (remainder(F.col("doc_id"), _FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
