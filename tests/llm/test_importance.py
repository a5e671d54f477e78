import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import importance, radix

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def whole(documents, target, ngram=1, buckets=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of all documents."""

    def hashed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in documents:
        s.update(hashed(text))
    for text in target:
        t.update(hashed(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in documents:
        f = hashed(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, len(words(text)) >= least, None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in rows), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé9 漢-"), max_size=80), max_size=6), st.integers(1, 3), st.integers(1, 5))
def test_features(texts, ngram, size):
    was, importance._SLICE = importance._SLICE, size
    try:
        got = [[] for _ in texts]
        for text, bucket in importance.features(pa.array(texts, pa.string()), ngram, 997):
            for a, b in zip(text.tolist(), bucket.tolist()):
                got[a].append(b)
    finally:
        importance._SLICE = was
    for text, found in zip(texts, got):
        w = words(text)
        want = [zlib.crc32(" ".join(w[i : i + n]).encode()) % 997 for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]
        assert sorted(found) == sorted(want)


def test_crc_of_long_ranges():
    flat = np.frombuffer(random.Random(1).randbytes(5000), dtype=np.uint8)
    starts = np.array([0, 0, 10, 4, 4999, 7])
    ends = np.array([5000, 0, 58, 53, 5000, 2000])
    assert importance.crc32(flat, starts, ends).tolist() == [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends)]


@pytest.mark.parametrize("low, high", [(-5, 5), (-(1 << 63), (1 << 63) - 1), (0, 0), (-(10**6), 10**9), (1 << 40, (1 << 40) + 3)])
def test_radix_ranks(make, monkeypatch, low, high):
    monkeypatch.setattr(radix, "CHUNK_BITS", 4)
    monkeypatch.setattr(radix, "_GROUP_BITS", 1)
    rng = random.Random(low)
    rows = [(rng.choice([low, high, rng.randint(low, high)]), rng.randint(-3, 3), k, "x") for k in range(400)]
    frame = make(rows, "a bigint, b int, c int, RANK string")
    got = radix.ranked(frame, [(F.col("a"), True), (F.col("b"), False), (F.col("c"), False)], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(400))
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))]


def test_radix_hot_key_and_stability(make, monkeypatch):
    monkeypatch.setattr(radix, "CHUNK_BITS", 5)
    rows = [(7 if k % 3 else k % 11, k) for k in range(500)]
    frame = make(rows, "a int, k int").coalesce(1)
    got = radix.ranked(frame, [(F.col("a"), False)], "place").orderBy("place").collect()
    assert [(r["a"], r["k"]) for r in got] == sorted(rows, key=lambda r: r[0])
    assert radix.ranked(make([], "a int"), [(F.col("a"), False)], "place").count() == 0


@pytest.mark.parametrize("ngram, buckets", [(1, 10_000), (2, 50)])
def test_edge_rows(make, ngram, buckets):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ba", "Do", "ré", "x9", "no", "q"]) for _ in range(rng.randrange(15, 60))) for _ in range(60)]
    rows = [(k // 2, t) for k, t in enumerate(texts)]  # two texts for each id
    rows += [(None, texts[0]), (None, texts[0]), (100, None), (101, ""), (102, "!?"), (103, "w" * 300 + " a" * 30), (5, texts[10])]
    target = ["ba do do", "ré x9", None, ""]
    documents = make([(i, t, "kept", 1.5) for i, t in rows], "doc_id bigint, text string, RANK string, `Score` double")
    got = importance.resampled(documents, make([(t,) for t in target], "text string"), ngram, buckets)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == whole(
        rows, target, ngram, buckets)


def test_other_columns_and_empty_tables(make):
    documents = make([(1, "a b", "kept")], "doc_id bigint, text string, `n.o` string")
    empty = make([], "text string")
    got = importance.resampled(documents, empty).collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "n.o": "kept", "n_words": 2, "n_features": 2, "weight": got[0]["weight"],
                                          "score": got[0]["score"], "rank": None}]
    assert importance.resampled(make([], "doc_id bigint, text string"), empty).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = importance.op11_importance(spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == whole(rows, target)
