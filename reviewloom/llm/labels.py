"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def remainder(doc_id, folds: int):
    """Fold of a document: CRC-32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fitted(documents: DataFrame, labels: DataFrame, label: str, learns, most: dict[int, int], train):
    """``train(texts, labels)`` over the bounded training sample, run in one task.

    The sample is drawn from the labels alone: of each value, the first ids in hash order, as
    many as ``most`` says. Those few ids are then looked up in the documents, so no other text
    moves, and none comes to the driver. An id with several rows gives its smallest text.
    """
    spark = documents.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*most)).groupBy("doc_id").agg(
        F.max(label).alias("label")).where(learns)
    drawn = []
    for value, limit in most.items():
        rows = one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        drawn += [(r["doc_id"], value, k) for k, r in enumerate(rows.select("doc_id").collect())]
    wanted = F.broadcast(spark.createDataFrame(drawn, "doc_id bigint, label int, place int"))
    found = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).join(
        wanted, "doc_id").groupBy("label", "place").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (-r["label"], r["place"]))
        model = train([r["text"] for r in rows], [r["label"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = found.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else train([], [])
