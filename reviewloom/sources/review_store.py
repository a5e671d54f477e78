"""Review storage by repository: bucketed tables that answer without a shuffle or a full scan.

``reviews`` is bucketed by ``place``, the hash of a repository and one of its few slots, over
which its reviews are dealt. The history of a repository reads the buckets of its slots only,
and one that owns a third of all rows is still spread over that many tasks and files.

``latest`` is bucketed by repository and gets at most one row per repository from each append,
so the latest reviews need no exchange and no task holds a hot repository's rows.

Both tables lie below a folder that the caller names and are declared in the session's catalog
when a store is opened. Buckets and slots are fixed with the first append.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import schemas
from reviewloom.operators.history import newest_first
from reviewloom.operators.ranking import keep_first
from reviewloom.session import exists, qualified

_LAYOUT = "buckets int, slots int, columns string"


@dataclass(frozen=True)
class ReviewStore:
    """Reviews below ``path``; ``columns`` needs ``repo_id``, ``review_id`` and ``created_at``."""

    spark: SparkSession
    path: str
    columns: str = schemas.REVIEW
    buckets: int = 64
    slots: int = 8

    def _place(self, repo: Column, slot: Column) -> Column:
        return F.xxhash64(repo.cast("string"), slot.cast("int"))

    def _table(self, kind: str, columns: str, key: str) -> str:
        """Declares a table over its folder and gives its name."""
        place = qualified(self.spark, f"{self.path.rstrip('/')}/{kind}")
        name = f"review_store_{kind}_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
        literal = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) "
            f"SORTED BY ({key}, created_at, review_id) INTO {self.buckets} BUCKETS LOCATION '{literal}'"
        )
        return name

    def _names(self) -> tuple[str, str]:
        layout, wanted = f"{self.path.rstrip('/')}/layout", (self.buckets, self.slots, self.columns)
        if not exists(self.spark, f"{layout}/_SUCCESS"):
            self.spark.createDataFrame([wanted], _LAYOUT).write.mode("overwrite").parquet(layout)
        found = tuple(self.spark.read.schema(_LAYOUT).parquet(layout).first())
        if found != wanted:
            raise ValueError(f"the store at {self.path} has buckets, slots and columns {found}")
        return (
            self._table("reviews", f"place bigint, {self.columns}", "place"),
            self._table("latest", self.columns, "repo_id"),
        )

    def append(self, reviews: DataFrame, again: bool = False) -> None:
        """Adds reviews, then the newest of each repository among them.

        After a failure in between, the same append with ``again`` adds only what is missing.
        """
        stored, latest = self._names()
        rows = self.spark.createDataFrame([], self.columns).unionByName(reviews)
        slot = F.pmod(F.xxhash64("review_id"), F.lit(self.slots))
        placed = rows.select(self._place(F.col("repo_id"), slot).alias("place"), *rows.columns)
        if again:
            known = self.spark.table(stored).select("place", "review_id")
            placed = placed.join(known, ["place", "review_id"], "left_anti").select("place", *rows.columns)
        self._insert(placed, stored, "place")
        self._insert(keep_first(rows, ["repo_id"], newest_first()), latest, "repo_id")

    def _insert(self, rows: DataFrame, table: str, key: str) -> None:
        """One file for each bucket, as rows are dealt to tasks in the way they are bucketed."""
        rows.repartition(self.buckets, key).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def latest(self) -> DataFrame:
        """The latest review of every repository; no exchange."""
        name = self._names()[1]
        table = self.spark.table(name)
        newest = F.max_by(F.struct(*table.columns), F.struct("created_at", "review_id"))
        return table.groupBy("repo_id").agg(newest.alias("r")).select("r.*")

    def history(self, *repo_ids) -> DataFrame:
        """All reviews of some repositories: reads their buckets only, without an exchange."""
        places = [self._place(F.lit(r), F.lit(k)) for r in repo_ids for k in range(self.slots)]
        table = self.spark.table(self._names()[0])
        return table.where(F.col("place").isin(*places) & F.col("repo_id").isin(*repo_ids)).drop("place")

    def histories(self, requests: DataFrame) -> DataFrame:
        """All reviews of the repositories in ``requests``; only the requests are moved."""
        slots = F.explode(F.sequence(F.lit(0), F.lit(self.slots - 1)))
        placed = requests.select("repo_id", slots.alias("slot")).select(
            "repo_id", self._place(F.col("repo_id"), F.col("slot")).alias("place"))
        # A place stands for one repository unless two hashes meet. The join is on the place
        # alone, as a second key would ask for another partitioning than that of the buckets.
        wanted = placed.groupBy("place").agg(F.collect_set("repo_id").alias("wanted"))
        joined = self.spark.table(self._names()[0]).join(wanted, "place")
        return joined.where(F.array_contains("wanted", F.col("repo_id"))).drop("place", "wanted")
