"""Language identification by multilingual mixtures (after Lui, Lau and Baldwin, 2014).

1. Per language, the counts of hashed byte trigrams and of their two-byte contexts over the
   words of all labelled training texts, added up in numpy arrays inside the reading tasks
   and then by Spark. They give each byte's probability after the two before it.
2. A text is a mixture: each of its words comes from one language, with the probability of
   its bytes there. Expectation-maximisation finds the share of each language.
3. The language set is chosen by penalised likelihood: the best single language first, then
   the two, three, ... languages with the largest shares, as long as the extended Bayesian
   information criterion improves. The shares of the chosen set are estimated anew.

The answer is the language with the largest share. Its score is that share; for a text of one
language it is the probability of that language against the others as sole languages.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no
shares, and so is every text if nothing could be learned; a null language is not learned;
documents with a null id are neither learned nor held out; repeated rows are learned and
answered each; ties go to the language first in order of name. The model has 2^17 + 2^16 numbers
for each language and no limit on texts; whole texts count, and what a task holds of a batch
grows with its words times the languages. Extra columns are kept but for those that bear a
name of the result in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.llm.labels import remainder
from reviewloom.llm.store import prepared, set_aside
from reviewloom.llm.text import LOWER, utf8, words

FOLDS, HELD_OUT = 3, 1
BUCKET_BITS = 17
#: Weight of the uniform distribution in each byte's probability, in occurrences.
SMOOTHING = 2.0
#: Largest change of a share at which its document is settled, and the most rounds.
SETTLED, ROUNDS = 1e-3, 1000
UNKNOWN = "und"
#: What one word may count against a language, as a logarithm: keeps its probability above 0.
_FARTHEST = -600.0
_SLICE_BYTES = 1 << 20
#: Words times languages that are worked on at once; a longer document stands alone.
_CELLS = 1 << 22
_BUCKETS, _CONTEXTS = 1 << BUCKET_BITS, 1 << 16

#: Bytes of words: ASCII letters and all bytes beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def grams(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """``(words, buckets, contexts, first)`` in slices of words: the trigrams of their bytes.

    Each word ends with a blank, which its last trigram predicts; before its first byte stand
    a blank and nothing. ``first`` is where each word's trigrams begin.
    """
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE_BYTES)))
        sizes = ends[at:to] - starts[at:to]
        first = np.cumsum(sizes + 1) - (sizes + 1)
        spread = np.full(int((sizes + 1).sum()) + 1, ord(" "), dtype=np.uint32)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spread[1 + np.repeat(first, sizes) + within] = LOWER[flat[np.repeat(starts[at:to], sizes) + within]]
        before = np.append(np.uint32(0), spread[:-2])
        before[spread[:-1] == ord(" ")] = 0
        contexts = (before << 8) | spread[:-1]
        code = (contexts << 8) | spread[1:]
        yield slice(at, to), (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), contexts, first
        at = to


@dataclass
class Model:
    """Logarithms per language: trigram counts, context counts, share of documents."""

    languages: list[str]
    trigrams: np.ndarray
    contexts: np.ndarray
    prior: np.ndarray


def model(languages: list[str], counts: np.ndarray, documents: np.ndarray) -> Model:
    """From one row of counts (trigrams, then contexts) a language, in order of name."""
    trigrams = np.log(counts[:, :_BUCKETS] + SMOOTHING / 256)
    contexts = np.log(counts[:, _BUCKETS:] + SMOOTHING)
    prior = np.log(np.maximum(documents, 1) / max(1, documents.sum()))
    return Model(languages, trigrams.T.astype(np.float32).copy(), contexts.T.astype(np.float32).copy(), prior)


def likelihoods(flat, starts, ends, m: Model) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(starts), len(m.languages)))
    for some, buckets, contexts, first in grams(flat, starts, ends):
        each = np.minimum(m.trigrams[buckets] - m.contexts[contexts], 0)
        out[some] = np.add.reduceat(each, first, axis=0, dtype=np.float64)
    return out


def mixtures(chances: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages of each text, and the log likelihood of its words.

    ``chances`` are the words' probabilities up to a factor a word, ``first`` the first word
    of each text (none is empty) and the end.
    """
    sizes = np.diff(first)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    gained = np.zeros(len(sizes))
    active = np.arange(len(sizes))
    for step in range(ROUNDS):
        of = np.repeat(np.arange(len(active)), sizes[active])
        heads = np.cumsum(sizes[active]) - sizes[active]
        joint = shares[active][of] * chances
        total = np.maximum(joint.sum(axis=1), 1e-300)
        gained[active] = np.add.reduceat(np.log(total), heads)
        new = np.add.reduceat(joint / total[:, None], heads, axis=0) / sizes[active][:, None]
        moved = np.abs(new - shares[active]).max(axis=1) > SETTLED
        shares[active] = new
        if not moved.any() or step == ROUNDS - 1:
            break
        active, chances = active[moved], chances[moved[of]]
    return shares, gained


def chosen(logs: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(language, score, shares)`` of each text (none is empty) by its words' likelihoods."""
    n, count = np.diff(first).astype(float), len(m.languages)
    alone = np.add.reduceat(logs, first[:-1], axis=0)
    posterior = alone + m.prior
    single = posterior.argmax(axis=1)
    rows = np.arange(len(n))
    odds = np.exp(posterior - posterior[rows, single][:, None])
    shares = np.zeros((len(n), count))
    shares[rows, single] = 1.0
    score = 1.0 / odds.sum(axis=1)
    if count == 1:
        return single, score, shares
    top = logs.max(axis=1)
    chances = np.exp(np.maximum(logs - top[:, None], _FARTHEST))
    base = np.add.reduceat(top, first[:-1])
    every, _ = mixtures(chances, first, np.ones((len(n), count)))
    order = np.argsort(-every, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(count), order.shape), axis=1)
    best = alone[rows, single] - math.log(count)
    open_ = rows
    for k in range(2, count + 1):
        sizes = np.diff(first)[open_]
        of = np.repeat(np.arange(len(n)), np.diff(first))
        part = chances[np.isin(of, open_)]
        heads = np.append(0, np.cumsum(sizes))
        with_k, gained = mixtures(part, heads, (place[open_] < k).astype(float))
        penalty = 0.5 * (k - 1) * np.log(n[open_]) + math.log(math.comb(count, k))
        value = base[open_] + gained - penalty
        better = value > best[open_]
        open_ = open_[better]
        if not len(open_):
            break
        best[open_], shares[open_] = value[better], with_k[better]
        score[open_] = shares[open_].max(axis=1)
    return shares.argmax(axis=1), score, shares


def answers(column: pa.Array, m: Model) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
    """Language, score and shares of each text."""
    flat, bounds = utf8(column)
    starts, ends, first = words(flat, bounds, LETTERS)
    size = len(bounds) - 1
    names, scores, shares = [UNKNOWN] * size, np.zeros(size), [[] for _ in range(size)]
    filled = np.flatnonzero(np.diff(first))
    at = 0
    while m.languages and at < len(filled):
        ahead = np.cumsum(np.diff(first)[filled[at:]]) * len(m.languages)
        some = filled[at : at + max(1, int(np.searchsorted(ahead, _CELLS, side="right")))]
        low, high = first[some[0]], first[some[-1] + 1]
        logs = likelihoods(flat, starts[low:high], ends[low:high], m)
        pick, score, share = chosen(logs, np.append(first[some], high) - low, m)
        for k, row in enumerate(some.tolist()):
            names[row], scores[row] = m.languages[pick[k]], score[k]
            ordered = np.argsort(-share[k], kind="stable")
            shares[row] = [(m.languages[i], float(share[k, i])) for i in ordered if share[k, i] > 0]
        at += len(some)
    return names, scores, shares


def fit(documents: DataFrame, lang: str = "lang", learns: Column | None = None) -> Model:
    """The model of all rows of ``documents`` (``text`` and the ``lang`` column) that ``learns`` admits."""
    prepared(documents.sparkSession)
    rows = documents.where(F.col(lang).isNotNull() & (F.lit(True) if learns is None else learns))
    width = _BUCKETS + _CONTEXTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column("lang").to_pylist(), dtype=object)
            for label in sorted(set(labels)):
                flat, bounds = utf8(batch.column("text").filter(pa.array(labels == label)))
                starts, ends, _ = words(flat, bounds, LETTERS)
                into = counts.setdefault(label, np.zeros(width, dtype=np.int64))
                into[-1] += len(bounds) - 1
                for _, buckets, contexts, _ in grams(flat, starts, ends):
                    into[:_BUCKETS] += np.bincount(buckets, minlength=_BUCKETS)
                    into[_BUCKETS:-1] += np.bincount(contexts, minlength=_CONTEXTS)
        for label, into in counts.items():
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(into[some])],
                names=["lang", "place", "n"])

    summed = (
        rows.select(F.col(lang).cast("string").alias("lang"), "text")
        .mapInArrow(run, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")))
    table = summed.toArrow()  # at most `width` rows a language
    languages = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(languages), width), dtype=np.int64)
    index = {name: k for k, name in enumerate(languages)}
    row = np.array([index[name] for name in table.column("lang").to_pylist()], dtype=np.int64)
    counts[row, table.column("place").to_numpy()] = table.column("n").to_numpy()
    return model(languages, counts[:, :-1], counts[:, -1])


def identified(documents: DataFrame, m: Model) -> DataFrame:
    """``documents`` without their text, with ``lang_pred``, ``score`` and ``shares``: the chosen
    languages, the largest share first."""
    spark = prepared(documents.sparkSession)
    added = {"lang_pred": "string", "score": "double", "shares": "array<struct<lang: string, share: double>>"}
    own = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in (*added, "text")], "text")
    # Java's class of letters; without one the words hold marks and digits only.
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    source, rest = set_aside(own.withColumn("text", lettered), "text")
    source = source.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()])
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = answers(batch.column("text"), shared.value)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            parts = [[{"lang": a, "share": b} for a, b in row] for row in shares]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(names, pa.string()), pa.array(scores), pa.array(parts, kind)],
                names=batch.schema.names)

    return source.mapInArrow(run, source.schema).select(*rest, *added)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, with the number of languages found in it."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = remainder(F.col("doc_id"), FOLDS)
    m = fit(documents, "lang", fold != HELD_OUT)
    return identified(documents.drop("lang"), m).select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.size("shares").alias("n_languages"))
