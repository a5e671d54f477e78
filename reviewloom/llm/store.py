"""Intermediate tables in the shared folder, and settings of Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.session import configure, scratch_dir


def prepared(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Session settings, and Arrow batches of bounded size however long the texts are."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = scratch_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def set_aside(frame: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The columns ``names``, all others in one struct, and the columns that bring those back.

    Columns of any name pass through Arrow functions in that struct, clashing and dotted ones too.
    """
    rest = [c for c in frame.columns if c not in names]
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("__rest")
    return frame.select(*names, held), [F.col(f"__rest.c{k}").alias(c) for k, c in enumerate(rest)]
