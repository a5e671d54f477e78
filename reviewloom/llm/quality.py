"""Quality by supervised subword embeddings.

Every word has one hashed feature, and one for each of its byte sequences of three to five
(with marks at both ends of the word); a word equal to the one before it has a further one.
A document is the mean of the vectors of all its features, and a softmax layer on it gives
the probability of each class. Vectors and layer are trained by stochastic gradient descent
in numpy, one labelled document at a time.

For scoring, the layer is applied to the vectors beforehand, so that a feature is a single
number; a batch of documents then adds up numbers of its distinct words.

The training sample is bounded: at most ``MOST`` labelled rows of each class, the first in
hash order of ``doc_id``, with their whole texts. All documents are scored over their whole
texts, and scores use nothing but the text.

Defined results: null texts count as empty; an empty text gets the probability of the bias
alone; a document with several labels takes the largest; without rows of both classes every
score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.labels import fitted, remainder
from reviewloom.llm.store import prepared
from reviewloom.llm.text import SPACED, mix, utf8, word_hashes, words

MOST = 2500
BUCKETS, DIMENSIONS = 1 << 17, 8
ROUNDS, RATE = 8, 0.5
SHORTEST, LONGEST_GRAM = 3, 5
_FOLDS, _HELD = 4, 2
_SAME = np.arange(256, dtype=np.uint8)
_REPEAT = 1  # bucket of "equal to the word before"


@dataclass(frozen=True)
class Model:
    """The value of each bucket after the layer, and the bias."""

    values: np.ndarray
    bias: float


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def word_features(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
    """Buckets of the features of each word, and which word each belongs to."""
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    of = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(total) - first[of]
    marked = np.full(total, 0x01, dtype=np.uint64)  # both ends
    inner = (within > 0) & (within < sizes[of] - 1)
    marked[inner] = flat[(starts[of] + within - 1)[inner]]
    buckets, owners = [_buckets(hashes)], [np.arange(len(starts))]
    for n in range(SHORTEST, LONGEST_GRAM + 1):
        at = np.flatnonzero(within <= sizes[of] - n)
        code = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | marked[at + k]
        buckets.append(_buckets(mix(code)))
        owners.append(of[at])
    return np.concatenate(buckets), np.concatenate(owners)


def _batches(flat: np.ndarray, bounds: np.ndarray):
    """Per document sums over a batch: distinct words, and each document's words among them."""
    starts, ends, first = words(flat, bounds, SPACED)
    hashes = word_hashes(flat, starts, ends, fold=_SAME)
    distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    buckets, owners = word_features(flat, starts[example], ends[example], distinct)
    repeated = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        repeated[1:] = hashes[1:] == hashes[:-1]
        repeated[first[:-1][first[:-1] < len(hashes)]] = False
    return first, which, buckets, owners, len(distinct), repeated


def _per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[first[1:]] - sums[first[:-1]]


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text of a string column."""
    flat, bounds = utf8(column)
    first, which, buckets, owners, n, repeated = _batches(flat, bounds)
    value = np.bincount(owners, weights=model.values[buckets], minlength=n)
    count = np.bincount(owners, minlength=n)
    total = _per_document(value[which] + repeated * model.values[_REPEAT], first)
    features = _per_document((count[which] + repeated).astype(np.float64), first)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(features, 1) + model.bias, -30, 30)))


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its features."""
    first, which, buckets, owners, n, repeated = _batches(*utf8(pa.array([text])))
    times = np.bincount(which, minlength=n)
    seen, place = np.unique(np.append(buckets, _REPEAT), return_inverse=True)
    share = np.bincount(place, weights=np.append(times[owners] if n else np.zeros(0), repeated.sum()))
    return seen, share / max(1.0, share.sum())


def train(
    texts: list[str], labels: list[int], overall: float | None = None, rounds: int = ROUNDS, rate: float = RATE
) -> Model:
    """Vectors and softmax layer by gradient descent; the order of steps is fixed.

    ``overall`` is the share of label 1 among all labelled rows, which the sample may not show.
    """
    y = np.array(labels, dtype=np.int64)
    rng = np.random.default_rng(0)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    rows = [_document(t) for t in texts]
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    steps, at = rounds * len(y), 0
    for _ in range(rounds):
        for k in rng.permutation(len(y)):
            buckets, share = rows[k]
            mean = share @ vectors[buckets]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            step = rate * (1 - at / steps) * weight[y[k]]
            vectors[buckets] -= step * share[:, None] * (layer @ p)[None, :]
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            at += 1
    # Both classes weighed the same while training; the bias now gets their true odds back.
    overall = float(y.mean()) if overall is None else overall
    odds = np.log(overall / (1 - overall))
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0] + odds))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    prepared(documents.sparkSession)
    learns = remainder(F.col("doc_id"), _FOLDS) != _HELD
    good, all_ = labels.where(F.col("quality").isin(0, 1) & learns).agg(
        F.sum(F.col("quality").cast("bigint")), F.count("*")).first()
    share = ((good or 0) + 1) / (all_ + 2)
    return fitted(documents, labels, "quality", learns, {0: MOST, 1: MOST}, partial(train, overall=share))


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the score of each text; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = documents.drop(name).withColumn(name, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values, pa.float64())], names=batch.schema.names)

    return columns.mapInArrow(run, columns.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(documents, model).select(
        "doc_id", (remainder(F.col("doc_id"), _FOLDS) == _HELD).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
