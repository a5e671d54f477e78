import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import mixture
from reviewloom.llm.text import utf8, words

MARK = 0x9E3779B1


def units(text):
    """Words of a text as lower-cased bytes."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[a-z\x80-\xff]+", low)


def gram_list(word):
    """(bucket, context) of each byte of a word and the blank after it."""
    out, before, last = [], 0, 32
    for byte in (*word, 32):
        context = before << 8 | last
        out.append((((context << 8 | byte) * MARK & 0xFFFFFFFF) >> (32 - mixture.BUCKET_BITS), context))
        before, last = last, byte
    return out


def fitted(rows):
    """Counts of trigrams, contexts and documents per language."""
    found = {}
    for text, lang in rows:
        if lang is not None:
            grams, contexts, n = found.setdefault(lang, (Counter(), Counter(), [0]))
            n[0] += 1
            for word in units(text):
                for g, c in gram_list(word):
                    grams[g] += 1
                    contexts[c] += 1
    return found


def log_chance(word, counts):
    grams, contexts, _ = counts
    a = mixture.SMOOTHING
    return sum(min(0.0, math.log(grams[g] + a / 256) - math.log(contexts[c] + a)) for g, c in gram_list(word))


def em(logs, allowed):
    """Shares and log likelihood of one text by plain loops."""
    share = {l: 1 / len(allowed) for l in allowed}
    while True:
        value, new = 0.0, dict.fromkeys(allowed, 0.0)
        for row in logs:
            top = max(row)
            joint = {l: share[l] * math.exp(row[l] - top) for l in allowed}
            total = sum(joint.values())
            value += top + math.log(total)
            for l in allowed:
                new[l] += joint[l] / total / len(logs)
        moved = max(abs(new[l] - share[l]) for l in allowed)
        share = new
        if moved <= mixture.SETTLED:
            return share, value


def answer(text, found):
    names = sorted(found)
    logs = [[log_chance(w, found[l]) for l in names] for w in units(text)]
    total = sum(found[l][2][0] for l in names)
    alone = [sum(r[k] for r in logs) for k in range(len(names))]
    post = [a + math.log(found[l][2][0] / total) for a, l in zip(alone, names)]
    one = max(range(len(names)), key=lambda k: (post[k], -k))
    score, share = 1 / sum(math.exp(p - post[one]) for p in post), {one: 1.0}
    best = alone[one] - math.log(len(names))
    every, _ = em(logs, range(len(names)))
    order = sorted(every, key=lambda k: -every[k])
    for k in range(2, len(names) + 1):
        with_k, value = em(logs, order[:k])
        value -= 0.5 * (k - 1) * math.log(len(logs)) + math.log(math.comb(len(names), k))
        if value <= best:
            break
        best, share = value, with_k
        score = max(share.values())
    return names[max(share, key=lambda k: (share[k], -k))], score, len(share)


def speech(lang, n, rng):
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "end", "üb", "ka"], "cc": ["ция", "на", "lo"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ é漢9-"), max_size=40), max_size=5), st.integers(1, 30))
def test_grams(texts, size):
    was, mixture._SLICE_BYTES = mixture._SLICE_BYTES, size
    try:
        flat, bounds = utf8(pa.array(texts, pa.string()))
        starts, ends, _ = words(flat, bounds, mixture.LETTERS)
        got = []
        for some, buckets, contexts, first in mixture.grams(flat, starts, ends):
            cuts = [*first.tolist(), len(buckets)]
            got += [list(zip(buckets[a:b].tolist(), contexts[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
            assert len(first) == some.stop - some.start
    finally:
        mixture._SLICE_BYTES = was
    assert got == [gram_list(w) for t in texts for w in units(t)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(speech(lang, rng.randrange(5, 40), rng), lang) for lang in ("aa", "bb", "cc", "aa") for _ in range(30)]


def test_model_and_answers_against_plain_loops(make, rows):
    rng = random.Random(6)
    documents = make([(k, t, l) for k, (t, l) in enumerate(rows)] + [(None, "x", None), (1, None, "bb")],
                     "doc_id int, text string, tongue string")
    m = mixture.fit(documents, "tongue")
    found = fitted([*rows, (None, "bb")])
    assert m.languages == ["aa", "bb", "cc"]
    for k, lang in enumerate(m.languages):
        grams, contexts, n = found[lang]
        for g in grams:
            assert math.isclose(m.trigrams[g, k], math.log(grams[g] + mixture.SMOOTHING / 256), rel_tol=1e-5)
        assert math.isclose(m.prior[k], math.log(n[0] / 121))
    texts = [speech(a, rng.randrange(1, 30), rng) + " " + speech(b, rng.randrange(1, 30), rng) for a in found for b in found for _ in range(6)]
    texts += ["ka", "lo lo", "q", "ü", "zzz " * 50]
    names, scores, shares = mixture.answers(pa.array(texts), m)
    for text, name, score, share in zip(texts, names, scores, shares):
        want = answer(text, found)
        assert (name, len(share)) == (want[0], want[2]) and math.isclose(score, want[1], abs_tol=5e-3)
    mixed = mixture.answers(pa.array([speech("bb", 300, rng) + " " + speech("cc", 100, rng)]), m)[2][0]
    assert [l for l, _ in mixed] == ["bb", "cc"] and abs(mixed[0][1] - 0.75) < 0.05
    # The result of a text does not depend on what it is worked on with.
    was, mixture._CELLS = mixture._CELLS, 40
    try:
        again = mixture.answers(pa.array(texts), m)
    finally:
        mixture._CELLS = was
    assert again[0] == names and np.allclose(again[1], scores)


def test_edge_rows(make, rows):
    documents = make([(k, t, l) for k, (t, l) in enumerate(rows)], "doc_id int, text string, lang string")
    m = mixture.fit(documents)
    long = speech("cc", 60_000, random.Random(1))
    given_rows = [(1, "ka lo mi", "p", 0), (1, "ka lo mi", "p", 0), (2, None, "q", 0), (3, "", "q", 0), (4, "12 -- 3!", "q", 0),
                  (5, "…—“", "q", 0), (None, "strend", "q", 0), (6, long, "q", 0), (7, "k" * 100_000, "q", 0)]
    frame = make(given_rows, "doc_id int, text string, SCORE string, `lang.x` int")
    got = mixture.identified(frame, m)
    assert got.columns == ["doc_id", "lang.x", "lang_pred", "score", "shares"]
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[k]["lang_pred"] for k in (1, 2, 3, 4, 5, None, 6)] == ["aa", "und", "und", "und", "und", "bb", "cc"]
    assert by_id[4]["score"] == 0 and by_id[4]["shares"] == [] and 0 <= by_id[7]["score"] <= 1
    assert got.where("doc_id = 1").count() == 2
    none = mixture.fit(make([], "doc_id int, text string, lang string"))
    assert {r["lang_pred"] for r in mixture.identified(frame, none).collect()} == {"und"}
    assert mixture.identified(make([], "doc_id int, text string"), m).count() == 0
    one = mixture.fit(make([(1, "ka", "aa")], "doc_id int, text string, lang string"))
    assert mixture.answers(pa.array(["strend ka"]), one)[0] == ["aa"]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = mixture.op13_language(spark, folder)
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    assert got.count() == documents.count()
    held = got.join(documents, "doc_id").where("held_out").select("lang", "lang_pred", "text", "score").collect()
    assert len(held) > 200 and all(0 <= r["score"] <= 1 for r in held)
    lettered = [r for r in held if any(c.isalpha() for c in r["text"] or "")]
    assert np.mean([r["lang"] == r["lang_pred"] for r in lettered]) > 0.99
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)).count() == 0
