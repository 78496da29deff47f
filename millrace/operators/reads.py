"""Selective and paged reads of stored postings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(rows: DataFrame, status: str | None = None, reason: str | None = None, source: str | None = None, since: datetime | None = None) -> DataFrame:
    """Rows that meet every given condition; all are pushed to the scan."""
    tests: list[Column] = [F.col(c) == v for c, v in (("status", status), ("reason", reason), ("source", source)) if v is not None]
    if since is not None:
        tests.append(F.coalesce("posted_at", "fetched_at") >= F.lit(since))
    for t in tests:
        rows = rows.where(t)
    return rows


def unscored(rows: DataFrame) -> DataFrame:
    """Shortlisted rows without a score that are not given up."""
    return rows.where((F.col("status") == "shortlisted") & F.col("score").isNull() & ~F.coalesce(F.col("unscored_final"), F.lit(False)))


def scored_unsent(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Scored rows whose id was never delivered."""
    return rows.where(F.col("score").isNotNull()).join(sent.select("id").distinct(), "id", "left_anti")


def page_after(rows: DataFrame, after: int | None, size: int, key: str = "id") -> DataFrame:
    """The next ``size`` rows by a unique key: the bound goes to the scan and a
    top-k picks the page, so no page costs more for lying far behind."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def recent(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The n newest rows, newest first."""
    return rows.orderBy(F.desc(order)).limit(n)


def since(rows: DataFrame, column: str, at: datetime) -> DataFrame:
    """Rows from a time on, oldest first."""
    return rows.where(F.col(column) >= F.lit(at)).orderBy(column)


def first_spellings(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, values): distinct values without regard to case, each in its first
    spelling, in order of first appearance."""
    first = rows.groupBy(*keys, F.lower(F.trim(value)).alias("_k")).agg(F.min(F.struct(order, F.trim(value).alias("v"))).alias("f"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["v"]).alias("values"))
