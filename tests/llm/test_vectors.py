import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reviewloom.llm import vectors

SCHEMA = "vec_id bigint, embedding array<double>, n_links string"


def brute(rows, threshold=0.95):
    """Links and components by all pairs in double precision; equal ids are one vector."""
    ids, xs = [], []
    for d, v in rows:
        x = None if not v or None in v else np.array(v, float)
        ok = d is not None and x is not None and np.isfinite(x).all() and (x != 0).any()
        ids.append(d)
        xs.append(x if ok else None)
    links = {}
    for i in range(len(rows)):
        links[i] = {
            j for j in range(len(rows))
            if xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and (ids[i] != ids[j])
            and xs[i] @ xs[j] / (np.linalg.norm(xs[i]) * np.linalg.norm(xs[j])) >= threshold}
    out = []
    for i, d in enumerate(ids):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = None if d is None else min(ids[j] for j in seen)
        out.append((d, len({ids[j] for j in links[i]}), component, d is None or d == component))
    return sorted(out, key=str)


def clustered(n, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dims))
    rows = []
    for k in range(n):
        x = centres[rng.integers(len(centres))] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((int(k * 3), x.tolist()))
    return rows


EDGES = [
    (9001, None), (9002, []), (9003, [0.0] * 16), (9004, [None] + [1.0] * 15), (9005, [float("nan")] + [1.0] * 15),
    (9006, [float("inf")] + [1.0] * 15), (9007, [1.0, 2.0, 3.0]), (9008, [2.0, 4.0, 6.0]), (9009, [1.0, 2.0, 3.0]),
    (9009, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (9010, [1e200] * 16),
]


def run(make, rows, **options):
    got = vectors.near_vectors(make([(d, v, "own") for d, v in rows], SCHEMA), **options).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_equals_brute_force(make):
    rows = clustered(220) + EDGES[:-1]
    assert run(make, rows) == brute(rows)


def test_overflowing_and_empty(make):
    assert run(make, EDGES[-1:]) == [(9010, 0, 9010, True)]
    assert run(make, []) == []


def test_recall_over_many_cells_and_blocks(make):
    rows = clustered(900, seed=4, dims=32)
    got = {r[0]: r for r in run(make, rows, cell=20, block=16)}
    want = {r[0]: r for r in brute(rows)}
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert all(got[d][1] <= want[d][1] for d in got)  # no pair below the threshold, none twice
    assert found >= 0.98 * there


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    x = np.array(table["embedding"].to_pylist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    there = int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r["n_links"] for r in vectors.op10_near_vectors(spark, folder).collect())
    assert 0.95 * there <= found <= there


def test_bounds_hold_and_spare_most_pairs():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(400, 64))
    raw[200:] = raw[:200] + rng.normal(size=(200, 64)) * 0.3
    first, second = np.arange(200), np.arange(200, 400)
    a, b, exact = vectors.tile_links(raw, first, second, 0.95)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    want = np.argwhere(unit[:200] @ unit[200:].T >= 0.95)
    assert sorted(zip(a, b - 200)) == sorted(map(tuple, want)) and len(want) > 20
    assert exact < 400


@pytest.mark.parametrize("n, cell, cells, least", [(16_384, 80, 204, 0.99), (65_536, 16, 4096, 0.95)])
def test_recall_of_planted_links(spark, tmp_path, n, cell, cells, least):
    """Random vectors with 1,000 pairs just above the threshold, both of each pair as queries
    against all vectors by brute force."""
    assert min(vectors.MAX_CELLS, n // cell) == cells
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=(1000, 64))
    aside -= (aside * x[:1000]).sum(axis=1, keepdims=True) * x[:1000]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x[1000:2000] = 0.9501 * x[:1000] + np.sqrt(1 - 0.9501**2) * aside
    want = np.concatenate([(x[at : at + 500] @ x.T >= 0.95).sum(axis=1) - 1 for at in range(0, 2000, 500)])
    ids = rng.permutation(n)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x))}), f"{tmp_path}/planted.parquet")
    frame = vectors.near_vectors(spark.read.parquet(f"{tmp_path}/planted.parquet"), cell=cell)
    links = {r["vec_id"]: r["n_links"] for r in frame.collect()}
    found = np.array([links[d] for d in ids[:2000].tolist()])
    there = int(want.sum())
    print(f"{cells} cells, {n} vectors: {int(found.sum())} of {there} links")
    assert len(links) == n and there >= 2000 and (found <= want).all()
    assert found.sum() >= least * there


def test_no_link_is_lost_among_many_cells(make):
    """Links between cells that are not next to each other count,."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=(400, 24))
    aside -= (aside * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x[400:800] = 0.9501 * x[:400] + np.sqrt(1 - 0.9501**2) * aside
    x[1100:] = x[1099] + rng.normal(size=(100, 24)) * 0.01
    rows = [(int(d), v.tolist()) for d, v in zip(rng.permutation(1200), x)]
    got = run(make, rows, cell=2, block=100)
    assert got == brute(rows) and sum(r[1] for r in got) > 800
