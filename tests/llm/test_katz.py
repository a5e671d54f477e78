import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewloom.llm import katz

SCHEMA = "doc_id bigint, text string"


def brute(rows, cut=katz.CUT, large=katz.LARGE):
    """The model by dictionaries."""

    def toks(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]

    def held(d):
        return d is not None and zlib.crc32(str(d).encode()) % 7 == 2

    c1, c2, ctx, docs = Counter(), Counter(), Counter(), 0
    for d, text in rows:
        if not held(d):
            t = toks(text)
            docs += 1
            c1.update(t)
            pairs = list(zip(["<s>", *t[:-1]], t))
            c2.update(pairs)
            ctx.update(h for h, _ in pairs)
    n, v = sum(c1.values()), len(c1)

    def stars(counts):
        of = Counter(counts.values())
        return katz.discounts([of[r] for r in range(1, cut + 2)])

    s1, s2 = stars(c1), stars(c2)
    star = lambda c, s: s[c] if c <= cut else c - large
    unknown = 1 - sum(star(c, s1) for c in c1.values()) / n if n else 1.0
    p1 = lambda w: star(c1[w], s1) / n if c1[w] else unknown
    seen, cover = defaultdict(float), defaultdict(float)
    for (h, w), c in c2.items():
        seen[h] += star(c, s2) / ctx[h]
        cover[h] += p1(w)
    alpha = {h: (1 - seen[h]) / (1 - cover[h]) for h in ctx}

    def p(w, h):
        if not ctx[h]:
            return p1(w)
        return star(c2[h, w], s2) / ctx[h] if c2[h, w] else alpha[h] * p1(w)

    out = {}
    for d, text in rows:
        t = toks(text)
        out[d, text] = (
            held(d), len(t), sum(c1[w] > 0 for w in t), n,
            sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t),
            sum(math.log10(p(w, h)) for h, w in zip(["<s>", *t[:-1]], t)))
    return out, p, list(c1), list(ctx)


def check(got, rows):
    want, p, vocabulary, contexts = brute(rows)
    by_id = defaultdict(list)
    for (d, _), value in want.items():
        by_id[d].append(value)
    assert len(got) == len(rows)
    for r in got:
        assert any(
            tuple(r[1:5]) == w[:4] and np.allclose(tuple(r[5:]), w[4:], rtol=1e-9, atol=1e-9) for w in by_id[r[0]]), r
    return p, vocabulary, contexts


def test_small_cases(make):
    rows = [(k, t) for k, t in enumerate([
        "the cat sat on the mat", "The cat\tran", "a dog sat on a log", "", None, "x", "the the the the the the the the",
        "cat dog cat dog cat dog", "rare words only here", "the cat sat on the mat", "unknown things entirely", "é ü ß é",
        "the cat sat", "a b c d e f g", "the mat sat"] * 2)] + [(None, "the cat")]
    got = katz.katz_scores(make(rows, SCHEMA), parts=3).collect()
    p, vocabulary, contexts = check(got, rows)
    for h in contexts:  # exactly normalised, the class of unknown words included
        assert sum(p(w, h) for w in vocabulary) + p("never seen", h) == pytest.approx(1, abs=1e-9)


def test_no_training_rows_and_empty_table(make):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    got = katz.katz_scores(make([(d, "a b") for d in held], SCHEMA), parts=2).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 2
    assert katz.katz_scores(make([], SCHEMA), parts=2).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = katz.op3_katz(spark, folder).collect()
    check(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("parts", [7, 8, 16, 200, 256])
def test_groups_are_dealt_evenly(parts):
    """First groups of many input splits, and all groups of few."""
    for groups in ([p << 24 for p in range(64 * parts)], [(p << 24) + n for p in range(8) for n in range(8 * parts)]):
        found = np.bincount([katz._part_of(g, parts) for g in groups], minlength=parts)
        assert found.max() <= 2 * np.median(found)
