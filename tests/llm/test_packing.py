from itertools import combinations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import packing


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    ends = packing.boundaries(lengths, counts, buckets)
    assert len(ends) <= buckets and ends == sorted(set(ends)) and ends[-1] == lengths[-1]
    best = min(
        padding(lengths, counts, [*some, lengths[-1]])
        for k in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], k))
    assert padding(lengths, counts, ends) == best


def check(rows, sizes, longest, buckets, budget):
    """rows of `packed` against the sizes (with end token) of all documents."""
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert sorted(sum((sorted(x["n_tokens"] for x in v) for v in of.values()), [])) == sorted(
        n for size in sizes for n in [longest] * (size // longest) + ([size % longest] if size % longest else []))
    lengths = sorted({r["n_tokens"] for r in rows})
    counts = [sum(r["n_tokens"] == x for r in rows) for x in lengths]
    ends = packing.boundaries(lengths, counts, buckets)
    batches = {}
    for r in rows:
        assert r["padded_to"] == min(e for e in ends if e >= r["n_tokens"]) == ends[r["bucket"]]
        assert r["first_token"] == r["piece"] * longest
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    for (bucket, batch), places in batches.items():
        most = max(1, budget // ends[bucket])
        assert sorted(places) == list(range(len(places))) and len(places) <= most
        full = max(b for k, b in batches if k == bucket) > batch
        assert len(places) == most or not full


def test_edge_rows(make):
    rows = [(1, "a b c", "z"), (1, "a b c", "z"), (2, None, "z"), (3, "", "z"), (None, "x " * 100, "z"), (5, "y " * 31, "z")]
    got = packing.packed(make(rows, "doc_id bigint, text string, batch string"), longest=16, buckets=3, budget=40).collect()
    check(got, [4, 4, 1, 1, 101, 32], 16, 3, 40)
    assert packing.packed(make([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(packing.word_tokens(F.col("text")).alias("n")).collect()
    check(packing.op5_packing(spark, folder).collect(), [r["n"] for r in docs], packing.LONGEST, packing.BUCKETS, packing.BUDGET)
