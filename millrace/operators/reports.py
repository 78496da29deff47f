"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.web import url_rejection
from millrace.runtime import cut


def funnel_by_source(decided: DataFrame) -> DataFrame:
    """(source, outcome, n)."""
    return decided.groupBy("source", "outcome").agg(F.count("*").alias("n"))


def funnel_with_totals(decided: DataFrame) -> DataFrame:
    """``funnel_by_source`` with a null row per source and over all."""
    return decided.rollup("source", "outcome").agg(F.count("*").alias("n"))


def summary(decided: DataFrame) -> DataFrame:
    """One row: evaluated, shortlisted, reasons as "reason:n,..." in order of
    first appearance, capped first."""
    by = decided.groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    kept = F.col("outcome") == "shortlisted"
    order = F.struct((F.col("outcome") != "capped").alias("c"), "first_id", "outcome", "n")
    reasons = F.array_sort(F.collect_list(F.when(~kept, order)))
    text = F.array_join(F.transform(reasons, lambda r: F.concat(r["outcome"], F.lit(":"), r["n"].cast("string"))), ",")
    return by.agg(F.sum("n").alias("evaluated"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("shortlisted"), text.alias("reasons"))


def fetch_report(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per source of the catalog (source, mode, hosts): rows fetched, kept and
    dropped by reason; sources without rows are listed with zeros.  The catalog
    is broadcast by Spark if it is small, else shuffled."""
    checked = rows.join(catalog, "source", "left").withColumn("rejection", url_rejection(F.col("url"), F.col("mode"), F.col("hosts")))
    counts = checked.groupBy("source").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("rejection").isNull()).alias("kept"), F.count_if(F.col("rejection") == "invalid_url").alias("dropped_invalid"),
        F.count_if(F.col("rejection") == "host").alias("dropped_host"))
    return catalog.select("source").join(counts, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns[1:]])


def day_counts(events: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    return events.groupBy(source, F.to_date(ts).alias("day")).agg(F.count("*").alias("call_count"))


def month_counts(days: DataFrame, source: str = "source") -> DataFrame:
    """Sums over calendar months."""
    return days.groupBy(source, F.trunc("day", "month").alias("month")).agg(F.sum("call_count").alias("call_count"))


def budget(days: DataFrame, policy: DataFrame, today: Column, source: str = "source") -> DataFrame:
    """(source, day_count, month_count, has_budget): one more call stays within
    the day's and the month's cap.  Sources without calls have zeros."""
    this_month = (F.col("day") >= F.trunc(today, "month")) & (F.col("day") < F.add_months(F.trunc(today, "month"), 1))
    used = days.groupBy(source).agg(F.sum(F.when(F.col("day") == today, F.col("call_count"))).alias("d"), F.sum(F.when(this_month, F.col("call_count"))).alias("m"))
    joined = policy.join(used, source, "left").withColumns({"day_count": F.coalesce("d", F.lit(0)), "month_count": F.coalesce("m", F.lit(0))})
    ok = (F.col("day_count") + 1 <= F.col("day_cap")) & (F.col("month_count") + 1 <= F.col("month_cap"))
    return joined.select(source, "day_count", "month_count", ok.alias("has_budget"))


def run_status(statuses: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """success without errors, failed with nothing else, else partial."""
    g = statuses.groupBy(run).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "error").alias("errors"))
    return g.withColumn("run_status", F.when(F.col("errors") == 0, "success").when(F.col("errors") == F.col("n"), "failed").otherwise("partial"))


def scoring_summary(rows: DataFrame) -> DataFrame:
    """attempted, scored, unscored, finally unscored, injection suspected."""
    return rows.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("score").isNotNull()).alias("scored"), F.count_if(F.col("score").isNull()).alias("unscored"),
        F.count_if(F.coalesce(F.col("final"), F.lit(False)) & F.col("score").isNull()).alias("final_unscored"),
        F.count_if(F.array_contains("notes", "injection_suspected")).alias("injection_suspected"))


def code_counts(rows: DataFrame, codes: str) -> DataFrame:
    """(code, n) over an array column."""
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def board_status(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Per board: candidates, parsed rows and a status; candidates of which none
    could be parsed are an error, not an empty success."""
    g = parsed.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(F.col("ok")).alias("parsed"))
    return g.withColumn("status", F.when((F.col("candidates") > 0) & (F.col("parsed") == 0), "error").otherwise("ok"))


def observed_status(parsed: DataFrame, boards: list[str], key: str = "board") -> tuple[DataFrame, DataFrame]:
    """(the rows as a written table, the statuses of the listed boards).

    The counts are observed while the rows are written, which is done anyway, so
    that the payloads are read once.  Boards are configuration: two counters each."""
    seen = Observation()
    of = [F.col(key) == b for b in boards]
    counters = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)] + [F.count_if(c & F.col("ok")).alias(f"p{i}") for i, c in enumerate(of)]
    table = cut(parsed.observe(seen, F.count("*").alias("all"), *counters))
    n = seen.get
    rows = [(b, n[f"n{i}"], n[f"p{i}"], "error" if n[f"n{i}"] and not n[f"p{i}"] else "ok") for i, b in enumerate(boards)]
    return table, parsed.sparkSession.createDataFrame(rows, f"`{key}` string, candidates long, parsed long, status string")


def output_summary(rows: DataFrame) -> DataFrame:
    """One row over outputs (action, letter, tweaks, codes): considered, cached,
    generated, incomplete, skipped, letters, tweaks, and failure codes as
    "code:n,..." by number and name."""
    done = F.col("letter").isNotNull() & F.col("tweaks").isNotNull()
    action = lambda a: F.col("action") == a
    codes = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    text = codes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), lambda x: F.concat(x["code"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("codes"))
    counts = rows.agg(
        F.count("*").alias("considered"), F.count_if(action("cached")).alias("cached"), F.count_if(action("generated") & done).alias("generated"), F.count_if(action("generated") & ~done).alias("incomplete"),
        F.count_if(action("skipped")).alias("skipped"), F.count("letter").alias("letters"), F.count("tweaks").alias("tweaks"))
    return counts.join(F.broadcast(text))  # one row each
