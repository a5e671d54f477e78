import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from reviewloom.llm import decontaminate as dc

DOCS, ITEMS = "doc_id bigint, text string, matches string, n_words int", "item_id bigint, text string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            t = words(item)
            n = min(window, len(t))
            wanted = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wanted:
                    hit.update(range(p, p + n))
                    found.add(str(item_id) if item_id is not None else "null")
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def cases():
    docs = [LONG, f"intro, {LONG.upper()}! outro " + "pad " * 40, None, "", "tiny item", "no match here", LONG,
            "x " * 5000 + LONG + " y" * 5000, "two three four", "é ü tiny! item, é ü", LONG + " " + LONG]
    items = [(1, LONG), (10, "Tiny item"), (2, None), (3, ""), (4, LONG), (None, "é ü"), (2, "nothing like it at all")]
    return docs, items


@pytest.mark.parametrize("block", [10, 10**6])
def test_edge_cases(make, block):
    docs, items = cases()
    frame = make([(k, t, "own", 7) for k, t in enumerate(docs)], DOCS)
    found = dc.with_verdict(dc.find_matches(frame, make(items, ITEMS), block_chars=block))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
           for r in found.collect()}
    assert got == dict(enumerate(brute(docs, items)))


def test_removal_keeps_columns_and_clean_rows(make):
    docs, items = cases()
    frame = make([(k, t, "own", 7) for k, t in enumerate(docs)], DOCS)
    kept = dc.remove_contaminated(frame, make(items, ITEMS))
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in enumerate(brute(docs, items)) if not v[-1]}
    assert dc.remove_contaminated(frame, make([], ITEMS)).count() == len(docs)
    assert dc.remove_contaminated(make([], DOCS), make(items, ITEMS)).count() == 0


def longest(text, items, window):
    """Longest run of words that the text shares with an item, from a whole window or short item on."""
    best = 0
    for item in items:
        for p in range(len(text)):
            for q in range(len(item)):
                size = 0
                while p + size < len(text) and q + size < len(item) and text[p + size] == item[q + size]:
                    size += 1
                if size >= window or 0 < len(item) == size:
                    best = max(best, size)
    return best


@pytest.mark.parametrize("n", [500, 2000])
def test_shared_passages_are_not_multiplied(n):
    import time

    import pyarrow as pa
    from reviewloom.llm.text import utf8

    passage = " ".join(LONG.split()[:13])
    suffixes = dc.TestSuffixes([str(k) for k in range(n)], [f"a{k} {passage} z{k}" for k in range(n)], 13)
    start = time.time()
    _, found, listed = dc.matches(*utf8(pa.array([f"u{k} {passage} v{k}" for k in range(n)])), suffixes, 13)
    assert all(len(own) == 1 for own in found) and all(len(ids) == n for ids in listed)
    assert time.time() - start < 1


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from reviewloom.llm.text import utf8

    monkeypatch.setattr(dc, "word_hashes", lambda flat, starts, ends: (ends - starts).astype(np.uint64))
    long = "y" * 100
    items = ["aa bb cc", f"aa {long}a x"]
    docs = ["aa BB cc", "bb aa cc", f"AA {long}a x", f"aa {long}b x", "dd"]
    suffixes = dc.TestSuffixes(["1", "2"], items, 3)
    found = dc.matches(*utf8(pa.array(docs)), suffixes, 3)[1]
    assert [[i for i, *_ in own] for own in found] == [[0], [], [1], [], []]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5),
       st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=4))
def test_search_equals_brute_force(docs, items):
    import numpy as np
    import pyarrow as pa

    docs, items = [" ".join(d) for d in docs], [" ".join(i) for i in items]
    suffixes = dc.TestSuffixes([str(k) for k in range(len(items))], items, 4)
    from reviewloom.llm.text import utf8

    counts, found, listed = dc.matches(*utf8(pa.array(docs)), suffixes, 4)
    for text, n, own, ids, want in zip(docs, counts, found, listed, brute(docs, list(enumerate(items)), 4)):
        hit = {x for _, _, at, size in own for x in range(at, at + size)}
        assert (int(n), len(hit), len(ids)) == want[:3]
        assert hashlib.sha256(",".join(suffixes.names[k] for k in ids).encode()).hexdigest() == want[3]
        assert max((size for *_, size in own), default=0) == longest(words(text), map(words, items), 4)
        for i, at, to, size in own:
            assert words(items[i])[at : at + size] == words(text)[to : to + size]
    assert isinstance(counts, np.ndarray)
