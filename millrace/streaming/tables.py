"""Tables that streams keep up to date batch by batch.

Each batch is applied exactly once in effect: what batch k writes depends on the
batch and on what batch k - 1 left, and goes to places named by k, so that a
repeated batch writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.runtime import cut, delete, discard, subfolders


class BucketTable:
    """One row per key, in buckets by the key's hash.

    A batch reads and writes only the buckets its keys fall in; a manifest per
    batch names the batch that last wrote each bucket.  Manifests have at most
    ``buckets`` rows.  Files that neither this nor the last manifest names are
    deleted, since a repeated batch needs the last one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def manifest(self, k: int) -> dict[int, int]:
        """Bucket to the batch that wrote it, after batch ``k``."""
        if k < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest/{k}").collect()
        return {r.bucket: r.batch for r in rows}

    def read(self, k: int) -> DataFrame:
        """The table after batch ``k``."""
        return self._open(self.manifest(k))

    def _open(self, buckets: dict[int, int]) -> DataFrame:
        at = [f"{self.path}/rows/{batch}/_b={b}" for b, batch in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def merge(self, k: int, batch: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``step(stored, batch)``, both of them
        rows of these buckets alone; returns the buckets."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        before = self.manifest(k - 1)
        merged = step(self._open({b: before[b] for b in touched if b in before}), batch)
        rows = merged.select(*self.schema.names).withColumn("_b", bucket).repartition(max(1, len(touched)), "_b")
        rows.write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/rows/{k}")
        after = before | dict.fromkeys(touched, k)
        self.spark.createDataFrame(list(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{k}")
        if k >= 2:
            older = self.manifest(k - 2)
            for b in (b for b in older if older[b] != before[b]):
                delete(self.spark, f"{self.path}/rows/{older[b]}/_b={b}")
            delete(self.spark, f"{self.path}/manifest/{k - 3}")
        return touched


def insert_absent(table: BucketTable, k: int, batch: DataFrame, order: list[str], report: str) -> None:
    """Insert the rows of batch ``k`` whose key is new; of equal keys in the
    batch the first by ``order``; stored rows never change.  How many rows came,
    went in and were known goes to ``report``/k."""
    names = table.schema.names
    whole = F.struct(*[F.col(c) for c in names])

    def step(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = stored.select(whole.alias("r"), F.lit(0).alias("_new"), F.lit(None).cast(new.schema[order[0]].dataType).alias("_o")).unionByName(new.select(whole.alias("r"), F.lit(1).alias("_new"), F.col(order[0]).alias("_o")))
        rank = F.struct("_new", "_o", *[F.col(f"r.{c}") for c in order[1:]])
        keyed = both.groupBy(*[F.col(f"r.{c}").alias(f"_k{i}") for i, c in enumerate(table.keys)])
        return keyed.agg(F.min_by("r", rank).alias("r"), F.min("_new").alias("fresh"), F.sum("_new").alias("came")).select("r.*", "fresh", "came")

    counted = []

    def keep(stored: DataFrame, new: DataFrame) -> DataFrame:
        counted.append(cut(step(stored, new)))
        return counted[0]

    table.merge(k, batch, keep)
    inserted = F.coalesce(F.sum("fresh"), F.lit(0))
    counted[0].agg(F.coalesce(F.sum("came"), F.lit(0)).alias("received"), inserted.alias("inserted"), (F.coalesce(F.sum("came"), F.lit(0)) - inserted).alias("duplicates")).write.mode("overwrite").parquet(f"{report}/{k}")
    discard(*counted)


def keep_best(table: BucketTable, k: int, batch: DataFrame, changes: str) -> None:
    """Keep the smallest ``best`` (a struct that ends with the row's id) per key.

    A better copy in batch ``k`` takes the place of the stored one.  What follows
    from that goes to ``changes``/k as (id, change): 1 for the new best copy, -1
    for the one it demotes, so that the sum of an id's changes tells whether it
    is the best one now.
    """
    key = table.keys[0]
    incoming = batch.groupBy(key).agg(F.min("best").alias("best"))  # copies are reduced before the shuffle
    made = []

    def step(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = stored.select(key, F.col("best").alias("old"), F.lit(None).cast(stored.schema["best"].dataType).alias("new")).unionByName(new.select(key, F.lit(None).cast(stored.schema["best"].dataType).alias("old"), F.col("best").alias("new")))
        made.append(cut(both.groupBy(key).agg(F.min("old").alias("old"), F.min("new").alias("new")).withColumn("best", F.least("old", "new"))))
        return made[0]

    table.merge(k, incoming, step)
    better = made[0].where("new is not null and (old is null or new < old)")
    moves = F.array(F.struct(F.col("new.id").alias("id"), F.lit(1).alias("change")), F.when(F.col("old").isNotNull(), F.struct(F.col("old.id").alias("id"), F.lit(-1).alias("change"))))
    better.select(F.inline(F.array_compact(moves))).write.mode("overwrite").parquet(f"{changes}/{k}")
    discard(*made)


class Removed(NamedTuple):
    """Days dropped whole, and days rewritten, by one batch."""

    dropped: list[str]
    rewritten: list[str]


class DayTable:
    """Rows by day (and batch) that are kept for some days; sent ones stay.

    Under ``rows`` a batch adds files to the days it has rows of.  Days before the
    boundary are dropped whole, after their sent rows went to ``sent``; only the
    boundary day is rewritten, by dynamic partition overwrite.  What a batch writes
    is its own rows, one day, and the sent rows of the days that expire with it;
    no earlier version of anything stays behind.  Days are listed from folder
    names: as many as the table keeps.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, time: str, days: int, unit: str = "yyyy-MM-dd"):
        self.unit = unit  # of the folders: days, or "yyyy-MM" for months
        self.spark, self.path, self.schema, self.time, self.days = spark, path, schema, time, days

    def read(self) -> DataFrame:
        at = [f"{self.path}/{x}" for x in ("rows", "sent") if subfolders(self.spark, f"{self.path}/{x}")]
        whole = [self.spark.read.schema(self.schema).parquet(x).select(*self.schema.names) for x in at]
        return whole[0].unionByName(whole[1]) if len(whole) == 2 else whole[0] if whole else self.spark.createDataFrame([], self.schema)

    def _put(self, rows: DataFrame, place: str) -> None:
        dated = rows.select(*self.schema.names, F.date_format(F.col(self.time), self.unit).alias("_day"), "_batch")
        dated = dated.hint("rebalance", "_day")  # a file per day, more for a large one
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_batch").parquet(f"{self.path}/{place}")

    def add(self, k: int, batch: DataFrame, sent: DataFrame, now: datetime, key: str = "id") -> Removed:
        """Add batch ``k``, then drop what was fetched before ``now`` - days and
        not sent.  Rows without a time are dropped, as expired ones are."""
        limit = now - timedelta(days=self.days)
        fresh = F.col(self.time) >= F.lit(limit)
        names = sent.select(F.col(key).alias("_key")).distinct()
        was_sent = lambda rows: rows.join(names, F.col(key) == F.col("_key"), "left_semi")
        batch = batch.select(*self.schema.names).withColumn("_batch", F.lit(k))
        self._put(batch.where(fresh), "rows")
        day = self.spark.range(1).select(F.date_format(F.lit(limit), self.unit)).first()[0]
        there = [x.removeprefix("_day=") for x in subfolders(self.spark, f"{self.path}/rows")]
        old = [x for x in there if x < day]
        expired = batch.where(~fresh)
        if old:
            expired = expired.unionByName(self._rows(*old).withColumn("_batch", F.lit(-k - 1)))  # beside what came late in batch k
        self._put(was_sent(expired), "sent")
        for x in old:
            delete(self.spark, f"{self.path}/rows/_day={x}")
        if day not in there:
            return Removed(old, [])
        part = self._rows(day)
        kept = cut(part.where(fresh).unionByName(was_sent(part.where(~fresh))))
        self._put(kept, "rows")
        left = {r[0] for r in kept.select("_batch").distinct().collect()}
        for x in subfolders(self.spark, f"{self.path}/rows/_day={day}"):  # overwriting leaves folders that get no rows
            if int(x.removeprefix("_batch=")) not in left:
                delete(self.spark, f"{self.path}/rows/_day={day}/{x}")
        discard(kept)
        return Removed(old, [day])

    def _rows(self, *days: str) -> DataFrame:
        """The rows of some days, with the number of the batch that brought them."""
        schema = StructType([*self.schema.fields, StructField("_batch", IntegerType())])
        at = [f"{self.path}/rows/_day={x}" for x in days]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*at).select(*self.schema.names, "_batch")
