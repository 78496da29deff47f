"""Queries over the event log: usage, budgets, attempts, streams."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import dedupe, filters, reports, scoring, state
from millrace.plans import core
from millrace.plans.postings import NOW, RULES, SOURCE_ORDER, described, postings
from millrace.runtime import cut, read
from millrace.streaming import jobs, ordered, tables


def events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def usage_by_day(spark, sf_dir):
    return _text(reports.day_counts(events(spark, sf_dir), "event_type"), "day")


def usage_by_month(spark, sf_dir):
    return _text(reports.month_counts(reports.day_counts(events(spark, sf_dir), "event_type"), "event_type"), "month")


def budget_gate(spark, sf_dir):
    days = reports.day_counts(events(spark, sf_dir), "event_type")
    policy = events(spark, sf_dir).select("event_type").distinct().select("event_type", F.lit(70).alias("day_cap"), F.lit(2000).alias("month_cap"))
    return reports.budget(days, policy, F.lit("2024-01-15").cast("date"), "event_type")


def usage_added(spark, sf_dir):
    days = reports.day_counts(events(spark, sf_dir).where("event_id % 2 = 0"), "event_type")
    more = events(spark, sf_dir).where("event_id % 2 = 1").select("event_type", F.to_date("ts").alias("day"))
    return _text(state.add_counts(days, more, ["event_type", "day"]), "day")


def latest_state(spark, sf_dir):
    return state.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


def attempt_cap(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("success"))
    return scoring.attempt_counts(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "failed_attempts", "final")


def first_valid_attempt(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("valid"), "value")
    return _text(scoring.first_valid_attempt(rows, ["user_id", "day"]), "day")


def run_status(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("run_id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return reports.run_status(rows)


def json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    k = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.try_variant_get(v, "$.k", "long"))
    return events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def _stream(spark, sf_dir):
    return jobs.read_events(spark, f"{sf_dir}/events.parquet")


def _table(name: str) -> str:
    return f"{name}_{uuid4().hex[:8]}"


def stream_usage(spark, sf_dir):
    return _text(jobs.run_to_table(jobs.daily_usage(_stream(spark, sf_dir), "event_type"), _table("usage"), "complete"), "day")


def stream_first_event(spark, sf_dir):
    out = jobs.run_to_table(jobs.keep_first(_stream(spark, sf_dir), ["user_id"], "60 days"), _table("first"), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


def _in_turn(spark, sf_dir, parts: int = 4) -> jobs.Arrivals:
    """The events in order of time, a fraction of the time they span in each
    batch."""
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    at = F.unix_micros("ts")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return jobs.Arrivals(rows, [F.lit(True)], "events")
    part = F.floor((at - lo) * parts / (hi - lo + 1))
    return jobs.Arrivals(rows, [part == i for i in range(parts)], "events")


def stream_insert_absent(spark, sf_dir):
    """First event per user and type as they arrive, in four batches that each
    span all of the time: no watermark, every duplicate is found."""
    rows = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    coming = jobs.Arrivals(rows, [F.col("event_id") % 4 == i for i in range(4)], "absent")

    def step(at: str, batch: DataFrame, k: int) -> None:
        table = tables.BucketTable(spark, f"{at}/table", rows.schema, ["user_id", "event_type"])
        tables.insert_absent(table, k, batch, ["event_id"], f"{at}/report")

    at, last = jobs.run_batches(coming.stream, "absent", step, coming)
    return tables.BucketTable(spark, f"{at}/table", rows.schema, ["user_id", "event_type"]).read(last)


def stream_closed_days(spark, sf_dir):
    """Days closed by the watermark, and events that came after that: the events
    whose id 50 divides come last of all."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "ts")
    late = F.col("event_id") % 50 == 0
    coming = jobs.Arrivals(rows, [~late, late], "days")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.closed_days(coming.stream, "event_type", "event_id"), _table("days"), "append", coming)
    counts = out.groupBy("event_type", "day").agg(F.sum(F.when(~F.col("late"), F.col("call_count"))).alias("closed"), F.count_if("late").alias("late"), F.sum(F.when(F.col("late"), F.col("id"))).alias("late_ids"))
    return _text(counts, "day")


def stream_attempts(spark, sf_dir):
    coming = _in_turn(spark, sf_dir)
    rows = coming.stream.withColumn("ok", F.col("event_type") != "error")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.attempts(rows, "user_id", "event_id", "ok", slot=1440 * ordered.MINUTE), _table("attempts"), "append", coming)
    return out.groupBy(F.col("key").alias("user_id")).agg(F.max("failed_attempts").alias("worst"), F.count_if("final").alias("n_final"))


def stream_minimum_interval(spark, sf_dir):
    coming = _in_turn(spark, sf_dir)
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.minimum_interval(coming.stream, "event_type", "event_id", 60), _table("interval"), "append", coming)
    return out.groupBy(F.col("key").alias("event_type")).agg(F.count("*").alias("accepted"), F.count_if("late").alias("late"))


def stream_filter(spark, sf_dir):
    """The rules on a stream of orders: the same column expressions; the smaller
    tables are joined as they stand.  The best copy per key is kept up as orders
    come: a better copy demotes the stored one."""
    coming = jobs.Arrivals(read(spark, sf_dir, "orders"), [F.col("o_orderkey") % 3 == i for i in range(3)], "orders")
    documents = cut(described(spark, sf_dir))
    rows = dedupe.with_key(filters.evaluate(filters.with_companies(postings(spark, sf_dir, orders=coming.stream, documents=documents)), RULES, NOW))
    rows = rows.withColumn("description_length", F.col("description_facts.length"))
    slim = rows.select("id", "passed", "reason", "dedupe_key", dedupe.quality(SOURCE_ORDER).alias("best"))
    best = slim.select("dedupe_key", "best").schema

    def step(at: str, batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{k}")
        batch = spark.read.schema(slim.schema).parquet(f"{at}/rows/{k}")
        tables.keep_best(tables.BucketTable(spark, f"{at}/best", best, ["dedupe_key"]), k, batch.where("passed").select("dedupe_key", "best"), f"{at}/changes")

    at, last = jobs.run_batches(slim, "filter", step, coming)
    if last < 0:
        return spark.createDataFrame([], slim.select("id", "passed", "reason", F.lit(True).alias("best")).schema)
    done = spark.read.schema(slim.schema).parquet(*[f"{at}/rows/{k}" for k in range(last + 1)])
    changes = spark.read.parquet(*[f"{at}/changes/{k}" for k in range(last + 1)])
    now = changes.groupBy("id").agg(F.sum("change").alias("n"))
    return done.join(now, "id", "left").select("id", "passed", "reason", (F.coalesce("n", F.lit(0)) == 1).alias("best"))


def stream_retention(spark, sf_dir):
    """Orders as a stream into a table by day that keeps 1500 days, and what was
    sent; the clock goes on by 200 days per batch and ends at ``NOW``."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("source"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("fetched_at"))
    sent = read(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("id"))
    coming = jobs.Arrivals(rows, [F.col("id") % 3 == i for i in range(3)], "retention")

    def step(at: str, batch: DataFrame, k: int) -> None:
        tables.DayTable(spark, f"{at}/table", rows.schema, "fetched_at", 1500, "yyyy-MM").add(k, batch, sent, min(NOW, NOW - timedelta(days=200 * (2 - k))))

    at, _ = jobs.run_batches(coming.stream, "retention", step, coming)
    kept = tables.DayTable(spark, f"{at}/table", rows.schema, "fetched_at", 1500, "yyyy-MM").read()
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.sum(F.col("id") % 1000).alias("check_sum"))


QUERIES = {f.__name__: f for f in (
    usage_by_day, usage_by_month, budget_gate, usage_added, latest_state, attempt_cap, first_valid_attempt, run_status, json_props, stream_usage, stream_closed_days, stream_first_event, stream_insert_absent, stream_attempts, stream_minimum_interval, stream_filter, stream_retention)}

_ATTEMPTS = """SELECT user_id, event_id, ts, event_type <> 'error' AS ok,
    sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events"""
_COUNTED = f"""SELECT user_id, event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failed_attempts FROM ({_ATTEMPTS})"""
_DAYS = "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS call_count FROM events GROUP BY 1, 2"
ORACLE = {
    "usage_by_day": _DAYS,
    "usage_by_month": "SELECT event_type, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, count(*) AS call_count FROM events GROUP BY 1, 2",
    "budget_gate": """SELECT event_type, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') AS day_count, count(*) FILTER (ts >= '2024-01-01' AND ts < '2024-02-01') AS month_count,
        count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') + 1 <= 70 AND count(*) FILTER (ts >= '2024-01-01' AND ts < '2024-02-01') + 1 <= 2000 AS has_budget FROM events GROUP BY 1""",
    "usage_added": _DAYS,
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "attempt_cap": f"SELECT user_id, event_id, failed_attempts, failed_attempts >= 3 AS final FROM ({_COUNTED})",
    "first_valid_attempt": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id AS attempt, event_type = 'purchase' AS valid, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_type = 'purchase' DESC, CASE WHEN event_type = 'purchase' THEN event_id ELSE -event_id END) = 1""",
    "run_status": """SELECT user_id || '/' || CAST(ts AS DATE) AS run_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
        CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' ELSE 'partial' END AS run_status FROM events GROUP BY 1""",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "stream_usage": _DAYS,
    "stream_first_event": "SELECT user_id, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1",
    "stream_insert_absent": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 4, event_id) = 1",
    "stream_closed_days": """WITH marked AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, event_id % 50 = 0 AS last_of_all, max(ts) FILTER (event_id % 50 <> 0) OVER () AS first_clock, max(ts) OVER () AS clock FROM events),
        told AS (SELECT *, last_of_all AND day + INTERVAL 1 DAY <= first_clock - INTERVAL 1 DAY AS late, day + INTERVAL 1 DAY <= clock - INTERVAL 1 DAY AS closed FROM marked)
        SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN count(*) FILTER (NOT late) > 0 THEN count(*) FILTER (NOT late) END AS closed, count(*) FILTER (late) AS late, sum(event_id) FILTER (late)::BIGINT AS late_ids
        FROM told WHERE closed GROUP BY event_type, day""",
    "stream_attempts": f"""SELECT c.user_id, max(failed_attempts) AS worst, count(*) FILTER (failed_attempts >= 3) AS n_final FROM ({_COUNTED}) c JOIN events e USING (event_id)
        WHERE date_trunc('day', e.ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1""",
    "stream_minimum_interval": """WITH RECURSIVE accepted AS (
          SELECT event_type, min(ts) AS ts FROM events GROUP BY 1
          UNION ALL
          SELECT a.event_type, min(e.ts) FROM accepted a JOIN events e ON e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 60 MINUTE GROUP BY a.event_type)
        SELECT event_type, count(*) AS accepted, CAST(0 AS BIGINT) AS late FROM accepted WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1""",
    "stream_filter": core.EVALUATED + """, best AS (
          SELECT id FROM evaluated WHERE passed QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY description_is_snippet, length(description) DESC,
            CASE source WHEN 's1' THEN 0 WHEN 's2' THEN 1 WHEN 's3' THEN 2 ELSE 3 END, id) = 1)
        SELECT id, passed, reason, id IN (SELECT id FROM best) AS best FROM evaluated""",
    "stream_retention": core.ORACLE["purge_retention"],
}
