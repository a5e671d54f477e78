import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import quality, toxicity

ID = "doc_id bigint, text string, score string"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    y = np.asarray(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "do", "ti", "re", "lo", "su", "mi"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rude = ["wretchedfool", "blockhead", "numbskull"]
    texts, labels = [], []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(30, 150))]
        bad = rng.random() < 0.3
        for _ in range(len(t) // 25 + 1 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(rude)
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_learns_rare_words():
    texts, labels = corpus()
    model = toxicity.train(texts[:300], labels[:300])
    scores = toxicity.score(model, texts[300:])
    assert auc(labels[300:], scores) > 0.95
    assert toxicity.score(model, [""])[0] < 0.5 and toxicity.score(model, [])[:].size == 0
    assert toxicity.score(model, ["x" * 100_000])[0] < 0.9


def test_toxicity_learns_short_words():
    texts, labels = corpus()
    for rude, short in (("wretchedfool", "zug"), ("blockhead", "kek"), ("numbskull", "fy")):
        texts = [t.replace(rude, short) for t in texts]
    model = toxicity.train(texts[:300], labels[:300])
    assert auc(labels[300:], toxicity.score(model, texts[300:])) > 0.95


def test_windows_hold_the_whole_text():
    text = "Some words here. More é words\nand a" + "b" * 500 + " end!"
    joined = b"".join(toxicity.windows(text))
    assert joined.replace(b" ", b"") == text.replace(" ", "").encode().translate(toxicity._LOWER)
    assert max(map(len, toxicity.windows(text))) <= toxicity.WINDOW


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_without_both_classes_the_share_is_the_score(labels):
    share = (sum(labels) + 1) / (len(labels) + 2)
    texts = ["a b"] * len(labels)
    assert np.allclose(toxicity.score(toxicity.train(texts, labels), ["x", ""]), share)
    assert np.allclose(quality.score(quality.train(texts, labels), pa.array(["x", "", None])), share)


def test_quality_learns_and_scores_batches_alike():
    texts, labels = corpus(seed=2)
    model = quality.train(texts[:300], labels[:300])
    scores = quality.score(model, pa.array(texts[300:]))
    assert auc(labels[300:], scores) > 0.95
    one = [quality.score(model, pa.array([t]))[0] for t in texts[300:320]]
    assert np.allclose(scores[:20], one)
    whole = quality.score(model, pa.array([None, "", "   ", "w " * 50_000]))
    assert whole[0] == whole[1] == whole[2] and np.isfinite(whole).all()


def test_collapsed_score_is_the_softmax_of_the_mean_vector():
    text = "One one two"
    buckets, share = quality._document(text)
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS), 0.3)
    want = 1 / (1 + np.exp(-(share @ model.values[buckets] + 0.3)))
    assert np.isclose(quality.score(model, pa.array([text]))[0], want) and np.isclose(share.sum(), 1)


def labelled(make):
    texts, labels = corpus(300)
    docs = make([(k, t, "own") for k, t in enumerate(texts)] + [(1000, None, "own"), (1001, "", "own"), (None, "a", "own")], ID)
    rows = [(k, 1 - v, v) for k, v in enumerate(labels)] + [(0, None, None), (0, 1, 0), (5000, 1, 1), (None, 1, 1)]
    return docs, make(rows, "doc_id bigint, quality int, toxic int"), labels


@pytest.mark.parametrize("module, fold, of", [(toxicity, 0, 5), (quality, 2, 4)])
def test_held_out_labels_are_never_used(make, module, fold, of):
    docs, labels, _ = labelled(make)
    swapped = labels.selectExpr(
        "doc_id", *[f"CASE WHEN crc32(CAST(doc_id AS STRING)) % {of} = {fold} THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    first, second = (
        {r["doc_id"]: r["score"] for r in module.with_score(docs, module.fit(docs, x)).collect()} for x in (labels, swapped))
    assert first == second and len(first) == 303


def test_filter_keeps_columns(make):
    docs, labels, toxic = labelled(make)
    kept = toxicity.remove_toxic(docs, toxicity.fit(docs, labels))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {1000, 1001, None} <= ids
    wrong = sum((k in ids) == bool(v) for k, v in enumerate(toxic))
    assert wrong < 0.1 * len(toxic)
    assert toxicity.remove_toxic(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("query, label, cut, fold, of, least", [
    (toxicity.op4_toxicity, "toxic", 0.5, 0, 5, 0.9), (quality.op9_quality, "quality", 0.7, 2, 4, 0.97)])
def test_held_out_accuracy(spark, query, label, cut, fold, of, least):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = query(spark, folder).collect()
    assert len(rows) == 10_000
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= least
