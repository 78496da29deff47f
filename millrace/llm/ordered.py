"""One pass over a globally sorted table, in parallel.

Rows are dealt into buckets by ranges of the order, written once, and every
bucket is scanned in order.  What a scan needs from the buckets before or after
it (a last value, a sum, a next row) is one row per bucket, and only these rows
meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.runtime import cut, default_parallelism


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written as a table with a column ``_b``, the number of the range
    of ``order`` that a row lies in.  Equal rows share a range: end ``order``
    with a column that tells rows of a frequent key apart."""
    return cut(rows.repartitionByRange(default_parallelism(rows.sparkSession), *order).withColumn("_b", F.spark_partition_id()))


def scan(rows: DataFrame, order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` of ``in_ranges`` with more columns, all along ``order``: ``last``
    are the last values that are not null, up to and including the row; ``sums``
    are sums up to and including it; ``following`` are values of the next row.

    ``_b`` is dropped.  The rows that carry values between buckets are as many
    as the buckets and broadcast; a bucket without rows carries nothing.
    """
    last, sums, following = last or {}, sums or {}, following or {}
    rows = rows.withColumns({f"_{name}": c for name, c in {**last, **sums, **following}.items()})
    at = F.struct(*order)
    ends = [F.max_by(f"_{x}", F.when(F.col(f"_{x}").isNotNull(), at)).alias(f"_{x}") for x in last]
    ends += [F.sum(f"_{x}").alias(f"_{x}") for x in sums] + [F.min_by(f"_{x}", at).alias(f"_{x}") for x in following]
    along = Window.orderBy("_b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_{x}", True).over(before).alias(f"{x}_c") for x in last]
    carried += [F.sum(f"_{x}").over(before).alias(f"{x}_c") for x in sums] + [F.lead(f"_{x}").over(along).alias(f"{x}_c") for x in following]
    carry = rows.groupBy("_b").agg(*ends).select("_b", *carried)
    here = Window.partitionBy("_b").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    new = {x: F.last(f"_{x}", True).over(upto) for x in last} | {x: F.sum(f"_{x}").over(upto) for x in sums} | {x: F.lead(f"_{x}").over(here) for x in following}
    new |= {"_end": F.lead(F.lit(True)).over(here).isNull()} if following else {}
    out = rows.withColumns({x: c for x, c in new.items()}).join(F.broadcast(carry), "_b")
    full = {x: F.coalesce(x, f"{x}_c") for x in last} | {x: F.coalesce(x, F.lit(0)) + F.coalesce(f"{x}_c", F.lit(0)) for x in sums}
    full |= {x: F.when(F.col("_end"), F.col(f"{x}_c")).otherwise(F.col(x)) for x in following}
    return out.withColumns(full).drop("_b", "_end", *[f"_{x}" for x in new if x != "_end"], *[f"{x}_c" for x in full])
