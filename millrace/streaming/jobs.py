"""The same semantics on streams.

Event time is a TIMESTAMP (cast NTZ columns right after the scan).  State is
bounded by watermarks or by one value per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import shared_folder


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``read_table`` with ts as event time."""
    return read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table (one file or a folder of them) as a stream of its files.
    The path is given as a pattern, since a file source takes no single file
    otherwise."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def daily_usage(events: DataFrame, source: str, late: str = "1 day") -> DataFrame:
    """Tumbling one-day counters with late data."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), source).agg(F.count("*").alias("call_count")).select(source, F.to_date("window.start").alias("day"), "call_count")


def keep_first(events: DataFrame, keys: list[str], within: str = "7 days") -> DataFrame:
    """First event per key inside the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


class Arrivals:
    """Rows that come as a stream, one slice (a condition) after another.

    ``stream`` reads the folder that slices are written to.  A run over arrivals
    writes one, takes it in as one batch, stops, and starts again from its
    checkpoint for the next one."""

    def __init__(self, df: DataFrame, slices: list[Column], name: str):
        spark = df.sparkSession
        self.df, self.slices = df, slices
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}/in"
        df.limit(0).write.parquet(self.path)
        self.stream = spark.readStream.schema(df.schema).parquet(self.path)

    def each(self) -> Iterator[int]:
        """Writes a slice, yields its number, and so on."""
        for i, s in enumerate(self.slices):
            self.df.where(s).write.mode("append").parquet(self.path)
            yield i


def run_batches(stream: DataFrame, name: str, step: Callable[[str, DataFrame, int], None], arrivals: Arrivals | None = None) -> tuple[str, int]:
    """Run a finite stream, ``step(folder, batch, k)`` on each batch; the folder
    for what it writes and the number of the last batch (-1 if none came)."""
    at = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last = [-1]

    def put(batch: DataFrame, k: int) -> None:
        step(at, batch, k)
        last[0] = k

    for _ in arrivals.each() if arrivals else [0]:
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return at, last[0]


def run_to_table(stream: DataFrame, name: str, mode: str, arrivals: Arrivals | None = None) -> DataFrame:
    """Run a finite stream to its end and read its rows back.  Rows and the
    stream's checkpoint lie under ``spark.checkpoint.dir``; a complete result
    is written anew by every batch, and the last one counts."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    last = [f"{at}/rows"]

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/v={k}")
        last[0] = f"{at}/rows/v={k}"

    for _ in arrivals.each() if arrivals else [0]:
        out = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        out = out.format("parquet").option("path", f"{at}/rows") if mode == "append" else out.foreachBatch(put)
        out.outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0])
