"""State, reads, texts and replies over the driver's tables, with SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import filters, grounding, reads, replies, reports, scoring, state, vocab
from millrace.plans.postings import NOW, ORACLE_POSTINGS, RULES, postings
from millrace.runtime import read


def orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"))


def pick(key: str, *values: str | None) -> Column:
    """One of some texts, by a key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: str | None) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


def known_salary(spark, sf_dir):
    rows = state.known_salary(postings(spark, sf_dir).select("currency", "salary_known", "salary_is_estimated"))
    return rows.groupBy("currency").agg(F.count_if("salary_known").alias("known"))


def company_gate(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 3 <> 0").select(F.lower("c_name").alias("name_key"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("is_gcc"), F.lit("x").alias("ats_type"), F.lit("x").alias("board_slug"))
    boards = c.where("c_custkey % 5 <> 0 or c_custkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.lit("A").alias("ats_type"), F.lower("c_name").alias("board_slug"))
    return state.gate_companies(stored, boards).select("name_key", F.trim("name").alias("name"), "is_gcc", "ats_type", "board_slug")


def replaced_by_key(spark, sf_dir):
    rows = orders(spark, sf_dir).select("cust", "id", "kind")
    return state.replace_by_key(rows.where("kind <> 'O'"), rows.where("kind = 'O'"), ["cust"], ["id"])


def appended_log(spark, sf_dir):
    """A log that is unique by key takes all orders twice; some are in it."""
    rows = orders(spark, sf_dir).select("id", "price")
    done = state.append_unique(rows.where("id % 4 = 0"), rows.unionByName(rows.withColumn("price", F.col("price") + 1)), ["id"], ["price"])
    return done.result.agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price")).join(F.broadcast(done.report)).join(F.broadcast(done.violations.agg(F.count("*").alias("refused"))))


def finished_runs(spark, sf_dir):
    """Runs (a user's day) with their latest end."""
    e = read(spark, sf_dir, "events").withColumn("run_id", F.concat_ws("/", "user_id", F.to_date("ts")))
    ends = e.where("event_type = 'purchase'").select("run_id", F.col("ts").cast("string").alias("finished_at"), F.col("value").alias("amount"))
    return state.finish_runs(e.select("run_id").distinct(), ends.groupBy("run_id", "finished_at").agg(F.max("amount").alias("amount")))


def run_history(spark, sf_dir):
    """Runs (one per day) from start to end with the statuses of their sources, and which is the last."""
    e = read(spark, sf_dir, "events").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    starts = e.groupBy("run_id").agg(F.min("ts").cast("string").alias("started_at")).withColumn("trigger", F.lit("schedule"))
    none = spark.createDataFrame([], "run_id string, source string, status string, job_count long, error string, duration_ms long")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("GET https://u:p@h.example?api_key=k"), F.col("n").cast("string")))
    counts = e.groupBy("run_id", "event_type").agg(F.count("*").alias("n"))
    statuses = state.add_statuses(none, counts.select("run_id", F.col("event_type").alias("source"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("n").alias("job_count"), error.alias("error"), F.lit(0).cast("long").alias("duration_ms")))
    shown = statuses.groupBy("run_id").agg(F.count("*").alias("sources"), F.max("error").alias("error"), F.sum("job_count").alias("fetched"))
    ends = shown.where("run_id not like '%7'").unionByName(shown.limit(1).withColumn("run_id", F.lit("unknown"))).select(
        "run_id", F.lit("success").alias("status"), F.lit("2024-12-31").alias("finished_at"), F.col("fetched").alias("fetched_count"), *[F.lit(0).cast("long").alias(c) for c in state.COUNTS[1:]], F.lit(None).cast("string").alias("notes"))
    done = state.end_runs(state.start_runs(spark.createDataFrame([], "run_id string").drop("run_id"), starts), ends)
    last = state.last_run(done.result).select("run_id", F.lit(True).alias("is_last"))
    return done.result.join(shown, "run_id").join(F.broadcast(last), "run_id", "left").join(F.broadcast(done.violations.agg(F.count("*").alias("refused")))).select(
        "run_id", "status", "fetched_count", "finished_at", "sources", "error", F.coalesce("is_last", F.lit(False)).alias("is_last"), "refused")


def applied_decisions(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("reason"), "price")
    decided = rows.where("id % 3 = 0").select("id", F.lit("rejected").alias("status"), pick("id", "age", None).alias("reason"))
    return state.apply_decisions(rows, decided, ["status", "reason"]).groupBy("status", "reason").agg(F.count("*").alias("n"))


def saved_scores(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, 50).alias("score"), F.lit("old").alias("details"))
    new = orders(spark, sf_dir).where("id % 2 = 0").select(
        F.when(F.col("id") % 10 == 0, F.col("id") + 100_000_000).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 6 != 0, F.col("id") % 130).cast("double").alias("score"), F.lit("new").alias("details"))
    done = state.save_scores(rows, new)
    return done.result.groupBy("details").agg(F.count("*").alias("n"), F.sum("score").alias("score")).join(F.broadcast(done.report))


def status_updates(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", F.lit("new").alias("status"))
    updates = orders(spark, sf_dir).where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 9 == 0, 100_000_000).otherwise(0)).alias("id"), pick("id", "shortlisted", "lost").alias("status"))
    done = state.update_status(rows, updates, ["new", "shortlisted", "rejected"])
    return done.result.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(done.violations.agg(F.count("*").alias("refused"))))


def company_dimension(spark, sf_dir):
    """Postings with the flags of their companies, by the rules' first reason."""
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.upper("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("is_blocked"), (F.col("c_custkey") % 7 == 0).alias("is_gcc"), (F.col("c_custkey") % 11 == 0).alias("is_preferred"))
    rows = rows.unionByName(rows.withColumns({x: F.lit(False) for x in ("is_blocked", "is_gcc", "is_preferred")}))  # a second row per company
    out = filters.evaluate(filters.with_companies(postings(spark, sf_dir), rows), RULES, NOW, (filters.BlockedCompany(),))
    return out.groupBy("passed", "reason", "company_is_centre", "company_preferred").agg(F.count("*").alias("n"))


def stored(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).select(
        "id", pick("id", "shortlisted", "rejected", "new").alias("status"), F.when(F.col("id") % 3 == 1, pick("id", "age", "title")).alias("reason"), F.col("kind").alias("source"),
        F.when(F.col("id") % 6 == 0, (F.col("id") % 101).cast("int")).alias("score"), (F.col("id") % 12 == 9).alias("unscored_final"), F.when(F.col("id") % 5 != 0, F.col("at")).alias("posted_at"), F.col("at").alias("fetched_at"))


def selective_reads(spark, sf_dir):
    """Numbers of rows that each kind of read gives."""
    rows, sent = stored(spark, sf_dir), orders(spark, sf_dir).where("id % 7 = 0").select("id")
    kinds = {
        "status": reads.select(rows, status="new"), "reason": reads.select(rows, "rejected", "age"), "source": reads.select(rows, "shortlisted", source="F"),
        "since": reads.select(rows, since=datetime(2000, 1, 1)), "unscored": reads.unscored(rows), "unsent": reads.scored_unsent(rows, sent), "later": reads.since(rows, "fetched_at", datetime(2001, 1, 1))}
    parts = [df.agg(F.lit(k).alias("read"), F.count("*").alias("n"), F.sum(F.col("id") % 1000).alias("ids")) for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paged_read(spark, sf_dir):
    """The page of 100 rows after id 1000."""
    return reads.page_after(stored(spark, sf_dir), 1000, 100).select("id", "status")


def recent_history(spark, sf_dir):
    """The 20 newest events."""
    return reads.recent(read(spark, sf_dir, "events"), 20, "event_id").select("event_id", "event_type")


def first_spellings(spark, sf_dir):
    """Distinct type words of each brand, without regard to case."""
    word = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", word.alias("w"))
    return reads.first_spellings(rows, ["p_brand"], "w", "p_partkey").select("p_brand", F.array_join("values", ",").alias("names"))


def scoring_totals(spark, sf_dir):
    rows = stored(spark, sf_dir).select("score", F.col("unscored_final").alias("final"), F.when(F.col("id") % 13 == 0, F.array(F.lit("injection_suspected"))).otherwise(F.array().cast("array<string>")).alias("notes"))
    return reports.scoring_summary(rows)


def output_totals(spark, sf_dir):
    codes = F.array_compact(F.array(F.when(F.col("id") % 4 == 0, "url"), F.when(F.col("id") % 6 == 0, "too_long")))
    return reports.output_summary(orders(spark, sf_dir).select(pick("id", "cached", "generated", "skipped").alias("action"), F.when(F.col("id") % 2 == 0, "x").alias("letter"), F.when(F.col("id") % 5 != 0, "y").alias("tweaks"), codes.alias("codes")))


def funnel_totals(spark, sf_dir):
    """Decided rows by source and outcome, with totals per source and over all."""
    decided = orders(spark, sf_dir).select(F.col("kind").alias("source"), F.when(F.col("price") > 150_000, "passed").otherwise("salary").alias("outcome"))
    return reports.funnel_with_totals(decided)


def kept_outputs(spark, sf_dir):
    """Outputs by part after their postings have been purged."""
    rows = orders(spark, sf_dir)
    outputs = rows.select(F.col("id").alias("job_id"), F.explode(F.array(F.lit("letter"), F.lit("tweaks"))).alias("part"))
    kept = state.purge(rows.withColumn("fetched_at", F.col("at")), rows.where("id % 17 = 0").select("id"), NOW, 1500).result
    return state.drop_orphans(outputs, kept).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("job_id") % 1000).alias("check_sum"))


def quality_violations(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), "kind", "price")
    bad = state.violations(rows, ["id"], {"kind": ["F", "O"]}, {"price": (2000.0, 100_000.0)})
    return rows.groupBy(F.array_join(bad, "; ").alias("broken")).agg(F.count("*").alias("n"))


def canonical_part_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    lines = p.where("p_partkey % 2 = 0").select(F.concat(F.upper("p_name"), F.lit("|"), "p_name").alias("value")).distinct()
    names = p.select("p_partkey", F.regexp_replace("p_name", " ", "-").alias("name"))
    return vocab.canonical_names(names, vocab.read_vocabulary(lines)).select("p_partkey", "canonical")


def skill_cleanup(spark, sf_dir):
    w = F.split("p_name", " ")
    rows = read(spark, sf_dir, "part").select("p_partkey", w.alias("matched_skills"), F.reverse(w).alias("missing_skills"))
    out = vocab.clean_skill_lists(rows, ["Small", "gear"], ["small", "large", "gear", "bolt"])
    return out.select("p_partkey", F.array_join("matched_skills", ",").alias("matched"), F.array_join("missing_skills", ",").alias("missing"), "changed")


def letter_paragraphs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Dear Sir,\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\nKind regards,\nme")).alias("t"))
    return rows.select("doc_id", F.size(grounding.paragraphs(F.col("t"))).alias("n"))


def refresh_actions(spark, sf_dir):
    ranked = orders(spark, sf_dir).select(F.col("id").alias("job_id"), (F.col("id") % 5 == 0).alias("sent"))
    stored_ = orders(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("job_id"), F.lit("letter").alias("part"), F.when(F.col("id") % 3 != 0, "v").alias("value"), pick("id", "1", "1", "2").alias("version"))
    out = replies.refresh_plan(ranked, stored_, ["letter", "tweaks"], "2", "outdated")
    return out.groupBy("part", "action").agg(F.count("*").alias("n"))


def merged_outputs(spark, sf_dir):
    old = orders(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("job_id"), F.lit("letter").alias("part"), F.lit("old").alias("value"), F.lit("1").alias("version"))
    new = orders(spark, sf_dir).where("id % 3 = 0").select(F.col("id").alias("job_id"), F.lit("letter").alias("part"), F.when(F.col("id") % 4 != 0, "new").alias("value"), F.lit("2").alias("version"))
    return replies.merge_outputs(old, new).groupBy("value", "version").agg(F.count("*").alias("n"))


def kept_approvals(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    before = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")), 256).alias("content_hash"), F.lit(True).alias("approved"))
    return replies.approvals(d.select("doc_id", "text"), before)


def assembled_scores(spark, sf_dir):
    rows = orders(spark, sf_dir)
    posts = rows.select("id", F.lit(60).alias("location_score"), F.lit(50).alias("salary_score"), (F.col("id") % 2 * 60 + 40).alias("company_score"), (F.col("kind") == "P").alias("description_is_snippet"), (F.col("id") % 3).cast("int").alias("failed_attempts"))
    answers = rows.where("id % 4 <> 0").select("id", (F.col("id") % 101 + 0.5).alias("skills_fit"), (F.col("id") % 50).cast("double").alias("seniority_fit"), (F.col("id") % 5 != 0).alias("valid"))
    return scoring.assemble(posts, answers, RULES.weights).withColumn("notes", F.array_join("notes", ","))


QUERIES = {f.__name__: f for f in (
    known_salary, company_gate, replaced_by_key, appended_log, finished_runs, run_history, applied_decisions, saved_scores, status_updates, company_dimension,
    selective_reads, paged_read, recent_history, first_spellings, funnel_totals, kept_outputs, scoring_totals, output_totals, quality_violations, canonical_part_names, skill_cleanup, letter_paragraphs,
    refresh_actions, merged_outputs, kept_approvals, assembled_scores)}

_ID = "o_orderkey"
_STORED = f"""WITH s AS (SELECT o_orderkey AS id, {_pick_sql(_ID, 'shortlisted', 'rejected', 'new')} AS status, CASE WHEN o_orderkey % 3 = 1 THEN {_pick_sql(_ID, 'age', 'title')} END AS reason, o_orderstatus AS source,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 101 AS INTEGER) END AS score, o_orderkey % 12 = 9 AS final, o_orderdate AS fetched FROM orders) """
_READS = {
    "status": "status = 'new'", "reason": "status = 'rejected' AND reason = 'age'", "source": "status = 'shortlisted' AND source = 'F'", "since": "fetched >= TIMESTAMP '2000-01-01'",
    "unscored": "status = 'shortlisted' AND score IS NULL AND NOT final", "unsent": "score IS NOT NULL AND id % 7 <> 0", "later": "fetched >= TIMESTAMP '2001-01-01'"}
ORACLE = {
    "known_salary": f"WITH p AS ({ORACLE_POSTINGS}) SELECT currency, count(*) FILTER (salary_known AND NOT salary_is_estimated) AS known FROM p GROUP BY 1",
    "company_gate": """SELECT lower(c_name) AS name_key, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 0 END AS is_gcc,
        CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 3 = 0 THEN 'A' END AS ats_type, CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 3 = 0 THEN lower(c_name) END AS board_slug FROM customer""",
    "replaced_by_key": """SELECT o_custkey AS cust, o_orderkey AS id, o_orderstatus AS kind FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey DESC) = 1""",
    "appended_log": """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS price, 2 * count(*) AS received, count(*) FILTER (o_orderkey % 4 <> 0) AS inserted,
        2 * count(*) - count(*) FILTER (o_orderkey % 4 <> 0) AS refused FROM orders""",
    "finished_runs": """SELECT run_id, CAST(max(ts) FILTER (event_type = 'purchase') AS VARCHAR) AS finished_at, max_by(value, struct_pack(t := ts, v := value)) FILTER (event_type = 'purchase') AS amount
        FROM (SELECT *, user_id || '/' || CAST(ts AS DATE) AS run_id FROM events) GROUP BY 1""",
    "run_history": """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run_id FROM events), d AS (SELECT run_id, count(*) AS n, count(DISTINCT event_type) AS sources, count(*) FILTER (event_type = 'error') AS failed FROM e GROUP BY 1)
        SELECT run_id, CASE WHEN run_id LIKE '%7' THEN 'running' ELSE 'success' END AS status, CASE WHEN run_id LIKE '%7' THEN 0 ELSE n END AS fetched_count, CASE WHEN run_id NOT LIKE '%7' THEN '2024-12-31' END AS finished_at, sources,
          CASE WHEN failed > 0 THEN 'GET https://[redacted]@h.example?api_key=[redacted]' END AS error, run_id = max(run_id) OVER () AS is_last, CAST(1 AS BIGINT) AS refused FROM d""",
    "applied_decisions": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'new' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'age' END AS reason, count(*) AS n FROM orders GROUP BY 1, 2",
    "saved_scores": """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 50 END AS score FROM orders),
        n AS (SELECT id, CASE WHEN id % 6 <> 0 THEN id % 130 END AS s, id % 10 <> 0 AS known FROM o WHERE id % 2 = 0),
        r AS (SELECT o.id, CASE WHEN n.s IS NOT NULL THEN n.s ELSE o.score END AS score, n.id IS NOT NULL AND (n.s IS NOT NULL OR o.score IS NULL) AS hit
          FROM o LEFT JOIN n ON n.id = o.id AND n.known AND coalesce(n.s, 0) <= 100)
        SELECT CASE WHEN hit THEN 'new' ELSE 'old' END AS details, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, (SELECT count(*) FROM n) AS received,
          (SELECT count(*) FILTER (NOT known OR coalesce(s, 0) > 100) FROM n) AS refused FROM r GROUP BY 1""",
    "status_updates": """SELECT CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 9 <> 0 THEN 'shortlisted' ELSE 'new' END AS status, count(*) AS n,
        (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 9 = 0)) AS refused FROM orders GROUP BY 1""",
    "company_dimension": """SELECT NOT hit AS passed, CASE WHEN hit THEN 'blocked_company' END AS reason, o_custkey % 7 = 0 AS company_is_centre, o_custkey % 11 = 0 AS company_preferred, count(*) AS n
        FROM (SELECT o_custkey, o_custkey % 5 = 0 OR o_custkey = 3 AS hit FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL""",
    "selective_reads": _STORED + " UNION ALL ".join(f"SELECT '{k}' AS read, count(*) AS n, CAST(sum(id % 1000) AS BIGINT) AS ids FROM s WHERE {v}" for k, v in _READS.items()),
    "paged_read": _STORED + "SELECT id, status FROM s WHERE id > 1000 ORDER BY id LIMIT 100",
    "recent_history": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "first_spellings": """WITH w AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS w FROM part),
        f AS (SELECT p_brand, min(p_partkey) AS k, arg_min(w, p_partkey) AS w FROM w GROUP BY p_brand, lower(w)) SELECT p_brand, string_agg(w, ',' ORDER BY k) AS names FROM f GROUP BY 1""",
    "funnel_totals": "SELECT o_orderstatus AS source, CASE WHEN o_totalprice > 150000 THEN 'passed' ELSE 'salary' END AS outcome, count(*) AS n FROM orders GROUP BY ROLLUP (source, outcome)",
    "kept_outputs": """SELECT part, count(*) AS n, sum(o_orderkey % 1000)::BIGINT AS check_sum FROM orders, (VALUES ('letter'), ('tweaks')) p(part)
        WHERE o_orderkey % 17 = 0 OR o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 1500 DAY GROUP BY part""",
    "scoring_totals": _STORED + """SELECT count(*) AS attempted, count(score) AS scored, count(*) FILTER (score IS NULL) AS unscored, count(*) FILTER (final AND score IS NULL) AS final_unscored,
        count(*) FILTER (id % 13 = 0) AS injection_suspected FROM s""",
    "output_totals": """SELECT count(*) AS considered, count(*) FILTER (o_orderkey % 3 = 0) AS cached, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0) AS generated,
        count(*) FILTER (o_orderkey % 3 = 1 AND (o_orderkey % 2 = 1 OR o_orderkey % 5 = 0)) AS incomplete, count(*) FILTER (o_orderkey % 3 = 2) AS skipped, count(*) FILTER (o_orderkey % 2 = 0) AS letters,
        count(*) FILTER (o_orderkey % 5 <> 0) AS tweaks, 'url:' || count(*) FILTER (o_orderkey % 4 = 0) || ',too_long:' || count(*) FILTER (o_orderkey % 6 = 0) AS codes FROM orders""",
    "quality_violations": """SELECT concat_ws('; ', CASE WHEN o_orderkey % 10 = 0 THEN 'id is missing' END, CASE WHEN o_orderstatus = 'P' THEN 'kind is not allowed' END,
        CASE WHEN o_totalprice NOT BETWEEN 2000 AND 100000 THEN 'price is out of range' END) AS broken, count(*) AS n FROM orders GROUP BY 1""",
    "canonical_part_names": """SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS canonical FROM part""",
    "skill_cleanup": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), f AS (SELECT p_partkey, w,
          list_filter(w, lambda x: x NOT IN ('small', 'large', 'gear', 'bolt') OR x IN ('small', 'gear')) AS m,
          list_filter(list_reverse(w), lambda x: x NOT IN ('small', 'large', 'gear', 'bolt') OR x NOT IN ('small', 'gear')) AS n FROM w)
        SELECT p_partkey, array_to_string(m, ',') AS matched, array_to_string(n, ',') AS missing, len(m) <> len(w) OR len(n) <> len(w) AS changed FROM f""",
    "letter_paragraphs": """SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda p: trim(p, ' ') <> '' AND NOT regexp_matches(trim(p, ' '), '(?i)^(dear|hello|hi)\\b[^\\n]{0,60}$')
        AND NOT regexp_matches(trim(p, ' '), '(?i)^(kind |best |warm )?(regards|sincerely|thanks)\\b'))) AS INTEGER) AS n FROM documents""",
    "refresh_actions": """SELECT part, CASE WHEN o_orderkey % 5 = 0 THEN 'skip' WHEN part = 'letter' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 2 THEN 'keep' ELSE 'redo' END AS action, count(*) AS n
        FROM orders, (VALUES ('letter'), ('tweaks')) p(part) GROUP BY ALL""",
    "merged_outputs": """SELECT CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN '2' ELSE '1' END AS version,
        count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) GROUP BY ALL""",
    "kept_approvals": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, doc_id % 3 <> 0 AND doc_id % 2 = 1 AND text IS NOT NULL AS approved FROM documents",
    "assembled_scores": """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS ok, o_orderstatus = 'P' AS snippet FROM orders)
        SELECT id, CASE WHEN ok THEN CAST(floor((40 * (id % 101 + 1) + 20 * (id % 50) + 15 * 60 + 15 * 50 + 10 * (id % 2 * 60 + 40)) / 100.0::DOUBLE + 0.5) AS INTEGER) END AS score, NOT ok AS unscored,
          CASE WHEN ok THEN 0 ELSE CAST(id % 3 + 1 AS INTEGER) END AS failed_attempts, NOT ok AND id % 3 = 2 AS unscored_final,
          concat_ws(',', CASE WHEN snippet THEN 'snippet_only' END, CASE WHEN NOT ok THEN 'unscored' END) AS notes FROM r""",
}
