import random
import re

from reviewloom.llm import near_dup

SCHEMA = "doc_id bigint, text string, component_id string"


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows, k=3, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and (
                100 * len(a & b) >= percent * len(a | b)
            ):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def sample(n=260, seed=3):
    """Copies, edited copies of several degrees, chains and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(n):
        kind = k % 5
        if kind == 0:
            t = list(base)
        elif kind == 1:
            t = list(base)
            for _ in range(rng.randrange(1, 9)):
                t[rng.randrange(len(t))] = word()
        elif kind == 2:
            t = passage + [word() for _ in range(rng.randrange(2, 60))]
        elif kind == 3:
            t = [word() for _ in range(rng.randrange(0, 40))]
        else:
            t = texts[rng.randrange(len(texts))].split(" ")
            t[len(t) // 2 :] = [x.upper() for x in t[len(t) // 2 :]]
        texts.append(" ".join(t))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


EDGES = [(90001, None), (90002, ""), (90003, " \t\n"), (90004, "two words"), (90005, "TWO  words"), (None, "two words"),
         (90006, "x"), (90006, "x"), (90007, "a b c"), (90008, "a b c " * 3000)]


def test_components_equal_brute_force(make):
    rows = sample() + EDGES
    got = near_dup.near_duplicates(make([(d, t, "own") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_small_blocks_find_the_same(make, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = sample(180, seed=8)
    got = near_dup.near_duplicates(make([(d, t, "own") for d, t in rows], SCHEMA), percent=80, words_per_shingle=5, bands=40)
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == brute(rows, 5, 80)


def test_one_of_each_group_stays(make):
    rows = sample(100, seed=5) + EDGES
    frame = make([(d, t, "own") for d, t in rows], SCHEMA)
    kept = near_dup.keep_one(frame)
    assert kept.columns == frame.columns
    want = {c for d, _, c in brute(rows) if d is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)
    assert near_dup.keep_one(make([], SCHEMA)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    size = near_dup.BANDS * near_dup.ROWS
    for n, least in near_dup.least_matches(size, near_dup.BATCH, 0.85, near_dup.MISS):
        mean, spread = 0.85 * n, (0.85 * 0.15 * n) ** 0.5
        assert mean - 8 * spread < least < mean - 3.5 * spread
