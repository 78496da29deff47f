"""Payload pages from files, as a table or as a stream.

A folder holds ``source=<name>/board=<name>/page_no=<n>/`` with one file each, the
body of one page.  It is read by Spark's own text source, so it may lie in any
file system that Spark reads, and a stream's offsets are the files it has seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "value string, source string, board string, page_no int"


def write_pages(raw: DataFrame, path: str) -> None:
    """Pages (source, board, page_no, body) as files; earlier pages stay."""
    raw.select(F.col("body").alias("value"), "source", "board", "page_no").write.mode("append").partitionBy("source", "board", "page_no").text(path)


def read_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """raw(source, board, page_no, fetched_at, body); fetched_at is when a file
    was written."""
    reader = (spark.readStream if stream else spark.read).schema(PAGE).option("wholetext", "true")
    body = F.regexp_replace("value", r"\n$", "")
    return reader.text(path).select("source", "board", "page_no", F.col("_metadata.file_modification_time").alias("fetched_at"), body.alias("body"))


def each_batch(adapter: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: a batch of pages through an adapter, whose stop
    rule then holds among the pages that came together."""
    return lambda batch, k: sink(adapter(batch), k)
