"""Best copy, keep-first and delivered-key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import dedupe_key


def with_key(postings: DataFrame) -> DataFrame:
    return postings.withColumn("dedupe_key", dedupe_key(F.col("company"), F.col("title"), F.col("location")))


def source_rank(source: Column, order: list[str]) -> Column:
    """Place in a priority list; unlisted sources come last."""
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(source == s, i).otherwise(out)
    return out


def quality(order: list[str]) -> Column:
    """What makes a copy better, smaller first: full text, longer description
    (by the column description_length), source priority, lower id."""
    return F.struct(F.col("description_is_snippet").alias("snippet"), (-F.coalesce("description_length", F.lit(0))).alias("shortness"), source_rank(F.col("source"), order).alias("rank"), F.col("id").alias("id"))


def best_ids(postings: DataFrame, order: list[str], key: str = "dedupe_key") -> DataFrame:
    """(key, id) of the best copy per key.  A pure aggregate: copies are reduced
    before the shuffle, however many a key has."""
    return postings.groupBy(key).agg(F.min(quality(order)).alias("best")).select(key, F.col("best.id").alias("best_id"))


def duplicate_reason(postings: DataFrame, order: list[str], sent_keys: DataFrame, retained: DataFrame, competing: Column, key: str = "dedupe_key") -> DataFrame:
    """``postings`` plus ``duplicate``: null, "already_sent" or "duplicate".

    ``sent_keys`` (key) are delivered keys, ``retained`` (key, id) the keys of
    rows kept earlier; a row never loses against itself.  Only rows for which
    ``competing`` holds take part in the choice of the best copy, since the
    choice is made among rows that pass all other rules.  What is known of a key
    is one aggregate, reduced before its shuffle, and meets the rows in one join."""
    parts = [(sent_keys, "_sent", F.lit(True)), (retained, "_id", F.col("id")), (postings.where(competing), "_q", quality(order))]
    facts = [rows.select(key, c.alias(name)) for rows, name, c in parts]
    known = facts[0].unionByName(facts[1], allowMissingColumns=True).unionByName(facts[2], allowMissingColumns=True)
    of_key = known.groupBy(key).agg(F.max("_sent").alias("_sent"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.min("_q").alias("_best"))
    joined = postings.join(of_key, key, "left").withColumn("best_id", F.col("_best.id"))
    other = F.coalesce((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")), F.lit(False))
    reason = F.when(F.col("_sent"), "already_sent").when(other, "duplicate").when(competing & (F.col("best_id") != F.col("id")), "duplicate")
    return joined.withColumn("duplicate", reason).drop("_sent", "_lo", "_hi", "_best", "best_id")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; also a map-side aggregate."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
