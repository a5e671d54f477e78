"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; cluster sizing (executors, shuffle partitions) stays with the cluster.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key of a join even when the step after it needs another shuffle then.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Bounds what one task of a shuffle sorts; at 64 MB that is a GB and more once it is unpacked.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # Hash instead of sort where the measured build side of every partition is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Lets the map-side group limit apply to the 5000-file cap as well.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # Keyed streaming state on local disk instead of the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Shuffle files go with the execution that made them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that the driver and all executors share.

    It lies under the cluster's ``spark.checkpoint.dir``, else under the warehouse; never
    under a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir", "")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``frame`` as files, and let go of its shuffles once they are there.

    Else shuffle files stay until the driver's garbage collector finds their frames, so a query of
    several writes holds those of all of them.
    """
    conf = frame.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        frame.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """Write ``frame`` to the shared scratch folder and read it back.

    Cuts the lineage, so later steps neither recompute it nor depend on lost executors.
    """
    path = scratch_dir(frame.sparkSession, purpose)
    written(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as Spark reads it: without a scheme it lies on the
    default file system, not on the disk of whichever machine looks."""
    place, system = _file_system(spark, path)
    return system.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, on whatever file system it lies."""
    place, system = _file_system(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a folder; none if it does not exist."""
    place, system = _file_system(spark, path)
    if not system.exists(place):
        return []
    return [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    place, system = _file_system(spark, path)
    return system.getContentSummary(place).getLength()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    place, system = _file_system(spark, path)
    system.delete(place, True)
