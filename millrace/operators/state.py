"""State tables as set-based merges.

Every function takes frames and returns new ones; nothing is written in place.
Write a result to a new path (``overwrite``), or hand it to ``mergeInto`` where
the table format supports it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import scrub_secrets


class Insert(NamedTuple):
    """Rows after the insert, what was refused, and counts."""

    result: DataFrame
    violations: DataFrame
    report: DataFrame


def violations(rows: DataFrame, required: Sequence[str] = (), enums: dict[str, Sequence[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """array<string> of broken constraints per row."""
    tests = [F.when(F.col(c).isNull(), f"{c} is missing") for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), f"{c} is not allowed") for c, v in (enums or {}).items()]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).between(lo, hi), f"{c} is out of range") for c, (lo, hi) in (ranges or {}).items()]
    return F.array_compact(F.array(*tests)) if tests else F.expr("cast(array() as array<string>)")


def insert_if_absent(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()) -> Insert:
    """Insert the rows of a batch whose key is new.

    Rows that break a constraint are refused; of equal keys in the batch the
    first by ``order`` counts, the rest are duplicates; stored rows never
    change."""
    marked = batch.withColumn("_bad", violations(batch, required))
    good, bad = marked.where(F.size("_bad") == 0).drop("_bad"), marked.where(F.size("_bad") > 0)
    whole = F.struct(*[F.col(c) for c in batch.columns])
    first = good.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("r"), F.count("*").alias("copies"))
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    checked = first.join(known, list(keys), "left")
    fresh = checked.where("_known is null").select("r.*")
    counts = checked.agg(F.coalesce(F.count_if(F.col("_known").isNull()), F.lit(0)).alias("inserted"), F.coalesce(F.sum("copies"), F.lit(0)).alias("valid"))
    total = marked.agg(F.count("*").alias("received"), F.count_if(F.size("_bad") > 0).alias("violations"))
    report = total.join(F.broadcast(counts)).select("received", "inserted", (F.col("valid") - F.col("inserted")).alias("duplicates"), "violations")
    return Insert(existing.unionByName(fresh, allowMissingColumns=True), bad, report)


def known_salary(rows: DataFrame) -> DataFrame:
    """An estimated salary is not a known one."""
    return rows.withColumn("salary_known", F.coalesce(F.col("salary_known") & ~F.coalesce(F.col("salary_is_estimated"), F.lit(False)), F.lit(False)))


FLAGS = ("is_gcc", "is_preferred", "is_blocked")


def upsert_companies(existing: DataFrame, updates: DataFrame, keep_flags: bool = False) -> DataFrame:
    """Merge by lower(trim(name)).

    Updates with ``flags_given`` replace all flags, nulls included; others keep
    the stored ones (``keep_flags``: always).  The displayed name is the newer
    one, first_seen the older.  Several updates of one company count in the
    order of their names, the last wins."""
    key = F.lower(F.trim("name")).alias("name_key")
    old = existing.select(key, F.struct("name", *FLAGS, "first_seen").alias("o")).groupBy("name_key").agg(F.min("o").alias("o"))
    new = updates.select(key, F.struct(F.trim("name").alias("name"), "flags_given", *FLAGS, "first_seen").alias("n")).groupBy("name_key").agg(F.max_by("n", "n.name").alias("n"))
    both = old.join(new, "name_key", "full_outer")
    given = F.lit(False) if keep_flags else F.coalesce(F.col("n.flags_given"), F.lit(False))
    return both.select(
        "name_key", F.coalesce("n.name", "o.name").alias("name"),
        *[F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in FLAGS],
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"))


def gate_companies(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """Set board type and slug of companies; flags and names stay as stored."""
    new = boards.select(F.lower(F.trim("name")).alias("name_key"), F.struct("name", "ats_type", "board_slug").alias("b")).groupBy("name_key").agg(F.max("b").alias("b"))
    stored = companies.drop("ats_type", "board_slug")
    return stored.join(new, "name_key", "full_outer").select(
        "name_key", F.coalesce("name", "b.name").alias("name"), *[c for c in stored.columns if c not in ("name_key", "name")], F.col("b.ats_type").alias("ats_type"), F.col("b.board_slug").alias("board_slug"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, by a map-side aggregate."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def replace_by_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key; updates replace stored rows."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_new", *order]).drop("_new")


def add_counts(existing: DataFrame, events: DataFrame, keys: Sequence[str], counter: str = "call_count") -> DataFrame:
    """Stored counters plus one for every event."""
    ones = events.select(*keys, F.lit(1).cast("long").alias(counter))
    return existing.select(*keys, counter).unionByName(ones).groupBy(*keys).agg(F.sum(counter).alias(counter))


def append_unique(existing: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Insert:
    """Append-only log that is unique by key: repeats come back as violations."""
    first = latest(rows, keys, [F.lit(0)]) if not order else None
    whole = F.struct(*[F.col(c) for c in rows.columns])
    first = first or rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
    fresh = first.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    refused = rows.exceptAll(fresh.select(*rows.columns))
    report = rows.agg(F.count("*").alias("received")).join(F.broadcast(fresh.agg(F.count("*").alias("inserted"))))
    return Insert(existing.unionByName(fresh, allowMissingColumns=True), refused, report)


COUNTS = ("fetched_count", "filtered_count", "shortlisted_count", "sent_count")


def start_runs(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """``runs`` and new ones (run_id, started_at, trigger) that are running, with
    all counts 0."""
    new = starts.select("run_id", "started_at", F.lit("running").alias("status"), "trigger", F.lit(None).cast("string").alias("finished_at"), *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("notes"))
    return runs.unionByName(new, allowMissingColumns=True) if runs.columns else new


def end_runs(runs: DataFrame, ends: DataFrame) -> Insert:
    """Runs with the status, time, counts and notes of their latest end; ends of
    unknown runs are violations."""
    last = latest(ends, ["run_id"], ["finished_at"]).select("run_id", F.struct("status", "finished_at", *COUNTS, "notes").alias("_e"))
    joined = runs.join(last, "run_id", "left")
    taken = ("status", "finished_at", *COUNTS, "notes")
    result = joined.select(*[F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in runs.columns])
    return Insert(result, ends.join(runs.select("run_id"), "run_id", "left_anti"), ends.agg(F.count("*").alias("received")))


def add_statuses(history: DataFrame, statuses: DataFrame) -> DataFrame:
    """Append statuses of sources (run_id, source, status, job_count, error,
    duration_ms); secrets leave the error texts."""
    return history.unionByName(statuses.withColumn("error", scrub_secrets(F.col("error"))))


def last_run(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The newest run, by a top-1."""
    return runs.orderBy(F.desc(order)).limit(1)


def finish_runs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs with the latest end event, if any."""
    return starts.join(latest(ends, ["run_id"], ["finished_at"]), "run_id", "left")


def apply_decisions(existing: DataFrame, decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` of the rows that ``decided`` (id, ...) names."""
    new = decided.select("id", F.struct(*columns).alias("_d"))
    joined = existing.join(new, "id", "left")
    return joined.select(*[F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def reset_for_reevaluation(rows: DataFrame) -> DataFrame:
    """Rejected rows, and shortlisted ones without a score, become new and lose
    what the filter derived."""
    hit = F.coalesce((F.col("status") == "rejected") | ((F.col("status") == "shortlisted") & F.col("score").isNull()), F.lit(False))
    cleared = [c for c in ("reason", "notes", "region", "hub_centre", "usd_min", "usd_max") if c in rows.columns]
    return rows.withColumns({"_hit": hit}).withColumns({"status": F.when(F.col("_hit"), "new").otherwise(F.col("status")), **{c: F.when(~F.col("_hit"), F.col(c)) for c in cleared}}).drop("_hit")


def save_scores(existing: DataFrame, scores: DataFrame) -> Insert:
    """Whole scores within 0..100 are stored; others, and unknown ids, are
    violations.  An unscored note (score null) only reaches rows without one."""
    bad = F.col("new_score").isNotNull() & ((F.col("new_score") != F.floor("new_score")) | ~F.col("new_score").between(0, 100))
    incoming = scores.select("id", F.col("score").cast("double").alias("new_score"), F.col("details").alias("new_details")).withColumn("_bad", bad)
    good = incoming.where("not _bad").drop("_bad")
    joined = existing.join(good.withColumn("_hit", F.lit(True)), "id", "left")
    take = F.col("_hit") & (F.col("new_score").isNotNull() | F.col("score").isNull())
    result = joined.select(*[
        F.when(take, F.coalesce(F.col("new_score").cast("int"), F.col("score"))).otherwise(F.col(c)).alias(c) if c == "score"
        else F.when(take, F.col("new_details")).otherwise(F.col(c)).alias(c) if c == "details" else F.col(c) for c in existing.columns])
    unknown = good.join(existing.select("id"), "id", "left_anti")
    refused = incoming.where("_bad").drop("_bad").unionByName(unknown)
    report = scores.agg(F.count("*").alias("received")).join(F.broadcast(refused.agg(F.count("*").alias("refused"))))
    return Insert(result, refused, report)


def update_status(existing: DataFrame, updates: DataFrame, allowed: Sequence[str]) -> Insert:
    """Set the status by id; unknown ids and statuses are violations."""
    good = updates.where(F.col("status").isin(*allowed)).groupBy("id").agg(F.max("status").alias("_status"))
    result = existing.join(good, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*existing.columns)
    refused = updates.where(~F.coalesce(F.col("status").isin(*allowed), F.lit(False))).unionByName(updates.where(F.col("status").isin(*allowed)).join(existing.select("id"), "id", "left_anti"))
    return Insert(result, refused, updates.agg(F.count("*").alias("received")))


class Purge(NamedTuple):
    result: DataFrame
    removed: DataFrame


def purge(rows: DataFrame, sent: DataFrame, now: datetime, days: int) -> Purge:
    """Drop rows fetched before now - days unless they were sent.  ``removed``
    holds the number."""
    marked = rows.join(sent.select("id").distinct().withColumn("_sent", F.lit(True)), "id", "left")
    keep = (F.col("fetched_at") >= F.lit(now) - F.make_dt_interval(F.lit(days))) | F.coalesce(F.col("_sent"), F.lit(False))
    marked = marked.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return Purge(marked.where("_keep").drop("_sent", "_keep").select(*rows.columns), marked.agg(F.count_if(~F.col("_keep")).alias("removed")))


def drop_orphans(outputs: DataFrame, rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Outputs of rows that are still there."""
    return outputs.join(rows.select(F.col("id").alias(key)), key, "left_semi")
