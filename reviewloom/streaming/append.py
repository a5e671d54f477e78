"""Idempotent append of reviews from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_stream(reviews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts an append of a streaming ``reviews`` table to parquet.

    The file sink commits each micro-batch once by its id, so a batch replayed after a
    failure does not add rows again.
    """
    return (
        reviews.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
