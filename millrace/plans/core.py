"""Queries over the derived postings: filters, copies, caps, rankings, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import money
from millrace.functions import text as X
from millrace.operators import dedupe, filters, reports, scoring, state
from millrace.plans.postings import NOW, ORACLE_POSTINGS, RULES, SOURCE_ORDER, postings
from millrace.runtime import cut, read


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the decision of the standard rules and their dedupe key."""
    rows = filters.with_companies(postings(spark, sf_dir))
    return dedupe.with_key(filters.evaluate(rows, RULES, NOW))


def sent_keys(rows: DataFrame) -> DataFrame:
    """Keys of rows delivered before, for the demonstration every 170th."""
    return rows.where("id % 170 = 0").select("dedupe_key")


def decided(spark: SparkSession, sf_dir: str, retained: str = "false") -> DataFrame:
    """Every posting with its outcome: shortlisted or the first reason.

    ``retained`` tells which postings that passed were kept by an earlier run.
    The rules run once; what they decided is cut from its lineage without the
    descriptions, of which only the length is needed further on."""
    rows = evaluated(spark, sf_dir)
    length = F.col("description_facts.length") if "description_facts" in rows.columns else F.length("description")
    rows = cut(rows.withColumn("description_length", length).drop("description", "description_facts"))
    kept = rows.where(F.col("passed") & F.expr(retained)).select("dedupe_key", "id")
    out = dedupe.duplicate_reason(rows, SOURCE_ORDER, sent_keys(rows), kept, F.col("passed"))
    return out.withColumn("outcome", F.coalesce("reason", "duplicate", F.lit("shortlisted")))


def filter_first_reason(spark, sf_dir):
    return evaluated(spark, sf_dir).select("id", "passed", "reason", "notes", "region", "hub_centre", F.round("usd_min", 4).alias("usd_min"), F.round("usd_max", 4).alias("usd_max"))


def filter_funnel(spark, sf_dir):
    return reports.funnel_by_source(decided(spark, sf_dir))


def filter_explain_steps(spark, sf_dir):
    rows = filters.with_companies(postings(spark, sf_dir))
    return filters.explain(rows, RULES, NOW).groupBy("step", "name", "passed", "reason").agg(F.count("*").alias("n"))


def run_summary(spark, sf_dir):
    return reports.summary(decided(spark, sf_dir))


def best_copy_per_key(spark, sf_dir):
    return dedupe.best_ids(postings(spark, sf_dir).withColumn("dedupe_key", X.dedupe_part(F.col("title"))).withColumn("description_length", F.col("description_facts.length")), SOURCE_ORDER)


def keep_first_per_id(spark, sf_dir):
    """One row per document id, the first by the hash of its whole text."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("norm_md5"), "source")
    return dedupe.keep_first(rows, ["doc_id"], ["norm_md5", "source"])


def keep_first_per_text(spark, sf_dir):
    """The first document per whole normalised text (by its hash)."""
    rows = read(spark, sf_dir, "documents").select(F.md5(X.normalise(F.col("text"))).alias("norm_md5"), "doc_id", "source")
    return dedupe.keep_first(rows, ["norm_md5"], ["doc_id"])


def keep_first_per_url(spark, sf_dir):
    return dedupe.keep_first(read(spark, sf_dir, "pages").select("url", "page_id"), ["url"], ["page_id"])


def scored(spark, sf_dir) -> DataFrame:
    """Shortlisted postings with pre-score and final score."""
    rows = decided(spark, sf_dir).where("outcome = 'shortlisted'")
    rows = rows.withColumn("pre_score", scoring.pre_score(RULES, NOW))
    parts = {
        "skills": F.col("id") % 101, "seniority": F.col("id") * 7 % 101,  # stand-ins for what a model's replies would give
        "location": scoring.location_score(), "salary": scoring.salary_score(RULES), "company": scoring.company_score(RULES)}
    preferred = scoring.is_preferred(F.col("company"), RULES, F.col("company_preferred"))
    return rows.withColumn("score", scoring.final_score(parts, RULES.weights)).withColumn("company_preferred", preferred)


def final_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "pre_score", "score", "company_preferred")


def shortlist_cap(spark, sf_dir):
    return scoring.cap(scored(spark, sf_dir), RULES.max_shortlist).select("id", "pre_score", "capped")


def daily_ranking(spark, sf_dir):
    sent = read(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("id"))
    return scoring.rank_list(scored(spark, sf_dir), sent, RULES).select("rank", "section", "id", "score", "company_preferred")


def currency_convert(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return rows.groupBy("currency").agg(F.count("*").alias("n"), F.round(F.sum(money.to_usd(F.col("salary_min"), F.col("currency"))), 2).alias("usd"))


def stored(spark, sf_dir) -> DataFrame:
    """Evaluated postings as the state table, every third row scored."""
    out = evaluated(spark, sf_dir).withColumn("status", F.when(F.col("passed"), "shortlisted").otherwise("rejected"))
    return out.withColumn("score", F.when(F.col("passed") & (F.col("id") % 3 == 0), (F.col("id") % 101).cast("int")))


SLIM = ["id", "external_id", "source", "title", "company", "fetched_at"]


def retained_outcomes(spark, sf_dir):
    """Outcomes after an earlier run that kept every second passed posting."""
    return decided(spark, sf_dir, "id % 2 = 0").select("id", "outcome")


def insert_if_absent(spark, sf_dir, incoming="id % 4 <> 0"):
    """Every row is stored (even ids), comes in (ids not divisible by 4) or both."""
    rows = postings(spark, sf_dir).select(*SLIM)
    old = rows.where("id % 2 = 0").withColumn("batch", F.lit("old"))
    new = rows.where(incoming).withColumn("batch", F.lit("new"))
    new = new.unionByName(new.where("id % 5 = 0").withColumn("title", F.lit("again")).withColumn("batch", F.lit("newer")))
    new = new.withColumn("title", F.when(F.col("id") % 33 == 0, F.lit(None)).otherwise(F.col("title")))
    return state.insert_if_absent(old, new, ["source", "external_id"], ["batch", "title"], ["title", "company"]).result.select("id", "source", "title", "batch")


def insert_if_absent_whole(spark, sf_dir):
    """Even ids are stored, every row comes in."""
    return insert_if_absent(spark, sf_dir, "true")


def insert_report(spark, sf_dir, incoming="id % 4 <> 0"):
    rows = postings(spark, sf_dir).select(*SLIM)
    new = rows.where(incoming).withColumn("title", F.when(F.col("id") % 33 == 0, F.lit(None)).otherwise(F.col("title")))
    return state.insert_if_absent(rows.where("id % 2 = 0"), new, ["source", "external_id"], ["id"], ["title", "company"]).report


def insert_report_whole(spark, sf_dir):
    return insert_report(spark, sf_dir, "true")


def purge_retention(spark, sf_dir):
    rows = postings(spark, sf_dir).select("id", "fetched_at", "source")
    sent = rows.where("id % 17 = 0").select("id")
    return state.purge(rows, sent, NOW, 1500).result.groupBy("source").agg(F.count("*").alias("kept"), F.sum(F.col("id") % 1000).alias("check_sum"))


def reset_for_reevaluation(spark, sf_dir):
    out = state.reset_for_reevaluation(stored(spark, sf_dir))
    return out.groupBy("status", F.col("reason").isNull().alias("no_reason"), F.col("usd_max").isNull().alias("no_usd")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def company_upsert(spark, sf_dir, incoming="c_custkey % 4 <> 0"):
    """Every customer is stored (even keys), comes in (keys not divisible by 4) or both."""
    c = read(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 4 == 0).alias("is_gcc"), F.lit(False).alias("is_preferred"), (F.col("c_custkey") % 10 == 0).alias("is_blocked"), F.lit("2001-01-01").alias("first_seen"))
    new = c.where(incoming).select(
        F.concat(F.lit(" "), F.upper("c_name")).alias("name"), (F.col("c_custkey") % 2 == 0).alias("flags_given"), F.lit(True).alias("is_gcc"),
        F.lit(None).cast("boolean").alias("is_preferred"), F.lit(False).alias("is_blocked"), F.lit("2001-08-02").alias("first_seen"))
    return state.upsert_companies(old, new)


def company_upsert_whole(spark, sf_dir):
    return company_upsert(spark, sf_dir, "true")


def fetch_report(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") % 6).cast("int").alias("n"), "url")
    rows = pages.select(F.concat(F.lit("feed"), F.col("n").cast("string")).alias("source"), "url")
    catalog = spark.range(8).select(
        F.concat(F.lit("feed"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") % 2 == 0, "any-https").otherwise("hosts").alias("mode"),
        F.array(F.lit("blog.tionsh.example.net"), F.lit("thther.example.org")).alias("hosts"))
    return reports.fetch_report(rows, catalog)


_S = r"'[ \t\n\r\f\v]+'"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _has(c: str, *phrases: str) -> str:
    return f"regexp_matches({_norm(c)}, '(^|[^0-9A-Za-z])({'|'.join(X.normalise_py(p) for p in phrases)})([^0-9A-Za-z]|$)')"


def _company(c: str) -> str:
    return f"trim(regexp_replace({_norm(c)}, '[^a-z0-9 ]+', '', 'g'))"


def _in(names) -> str:
    return "(" + ", ".join(f"'{X.normalise_company_py(n)}'" for n in names) + ")"


_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[\\p{{P}}]+', '', 'g'), '\\s+', ' ', 'g'))"
_RATE = "CASE currency " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RULES.rates.items()) + " END"
_ALLOWED = f"regexp_replace({_norm('title')}, '(^|[^0-9A-Za-z])(standard hot|standard new)([^0-9A-Za-z]|$)', '\\1 \\3', 'g')"
_REMOTE = _has("concat_ws(' | ', title, location, substr(description, 1, 1500))", "remote", "work from home", "wfh", "work from anywhere", "fully remote", "remote-first")

EVALUATED = f"""
WITH postings AS ({ORACLE_POSTINGS}),
facts AS (
  SELECT *, {_company('company')} IN {_in(RULES.blocked)} AS blocked,
    coalesce(posted_at, fetched_at) < TIMESTAMP '2001-08-02' - INTERVAL 1200 DAY AS old,
    CASE WHEN {_has('title', *RULES.exclude_keywords, *RULES.exclude_roles, *RULES.exclude_anywhere)} THEN 'title_excluded'
         WHEN regexp_matches({_ALLOWED}, '(^|[^0-9A-Za-z])standard([^0-9A-Za-z]|$)') THEN 'title_excluded'
         WHEN NOT {_has('title', *RULES.include_keywords, 'large old', 'blue ring')} THEN 'title_no_match'
         WHEN {_has('title', *RULES.exclude_employment)} THEN 'employment_type' END AS title_reason,
    {_has('location', 'nation 4')} AS hub, {_REMOTE} AS remote, {_company('company')} IN {_in(RULES.centre_seeds)} AS centre,
    {_has('location', *RULES.open_terms)} AS open_place, {_has('location', 'nation 3')} AS bad3, {_has('location', 'nation 9')} AS bad9,
    salary_min * {_RATE} AS usd_lo, salary_max * {_RATE} AS usd_hi,
    NOT salary_known OR salary_is_estimated OR ({_RATE}) IS NULL OR salary_min IS NULL AS no_salary
  FROM postings
), steps AS (
  SELECT *, CASE WHEN hub AND NOT remote AND NOT centre THEN 'not_gcc' WHEN NOT hub AND NOT open_place AND (bad3 OR bad9) THEN 'region_restricted' END AS place_reason,
    CASE WHEN NOT no_salary AND coalesce(usd_hi, usd_lo) < 150000 THEN 'salary_below_min' END AS salary_reason
  FROM facts
), ranked AS (
  SELECT *, CASE WHEN blocked THEN 1 WHEN old THEN 2 WHEN title_reason IS NOT NULL THEN 3 WHEN place_reason IS NOT NULL THEN 4 WHEN salary_reason IS NOT NULL THEN 5 ELSE 6 END AS stop
  FROM steps
), evaluated AS (
  SELECT id, source, title, company, location, description, description_is_snippet, posted_at, fetched_at, salary_known, salary_is_estimated, currency, stop = 6 AS passed,
    CASE stop WHEN 1 THEN 'blocked_company' WHEN 2 THEN 'too_old' WHEN 3 THEN title_reason WHEN 4 THEN place_reason WHEN 5 THEN salary_reason END AS reason,
    concat_ws('; ', CASE WHEN stop >= 4 AND hub AND remote THEN 'hub_remote' WHEN stop >= 4 AND place_reason = 'region_restricted' THEN CASE WHEN bad3 THEN 'nation 3' ELSE 'nation 9' END END,
      CASE WHEN stop >= 5 AND no_salary THEN 'salary_unknown' END) AS notes,
    CASE WHEN stop >= 4 THEN CASE WHEN hub THEN CASE WHEN remote THEN 'open' WHEN centre THEN 'unknown' END
      WHEN open_place THEN 'open' WHEN bad3 OR bad9 THEN 'restricted' ELSE 'unknown' END END AS region,
    CASE WHEN stop >= 4 THEN hub AND NOT remote AND centre END AS hub_centre,
    CASE WHEN stop >= 5 AND NOT no_salary THEN usd_lo END AS usd_min, CASE WHEN stop >= 5 AND NOT no_salary THEN usd_hi END AS usd_max,
    {_KEY.format('company')} || '|' || {_KEY.format('title')} || '|' || {_KEY.format('location')} AS dedupe_key
  FROM ranked
)"""
DECIDED = EVALUATED + """, best AS (
  SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY dedupe_key ORDER BY description_is_snippet, length(description) DESC,
    CASE source WHEN 's1' THEN 0 WHEN 's2' THEN 1 WHEN 's3' THEN 2 ELSE 3 END, id) AS rn FROM evaluated WHERE passed) WHERE rn = 1
), decided AS (
  SELECT e.*, coalesce(reason, CASE WHEN dedupe_key IN (SELECT dedupe_key FROM evaluated WHERE id % 170 = 0) THEN 'already_sent' END,
    CASE WHEN passed AND id NOT IN (SELECT id FROM best) THEN 'duplicate' END, 'shortlisted') AS outcome
  FROM evaluated e
)"""
SCORED = DECIDED + f""", scored AS (
  SELECT *, CAST(CASE WHEN pref THEN 30 ELSE 0 END + CASE WHEN {_has('title', 'large old', 'blue ring')} THEN 25 ELSE 0 END
      + CASE WHEN coalesce(posted_at, fetched_at) >= TIMESTAMP '2001-07-31' THEN 20 ELSE 0 END + CASE WHEN usd_max >= 150000 THEN 15 ELSE 0 END
      + CASE WHEN NOT description_is_snippet THEN 10 ELSE 0 END + CASE WHEN hub_centre THEN 20 ELSE 0 END + CASE WHEN region = 'open' THEN 10 ELSE 0 END AS INTEGER) AS pre_score,
    CAST(least(100, greatest(0, floor((40 * (id % 101)::DOUBLE + 20 * (id * 7 % 101)
      + 15 * CASE WHEN region = 'open' THEN 100 WHEN hub_centre THEN 90 ELSE 60 END
      + 15 * CASE WHEN NOT salary_known OR salary_is_estimated OR coalesce(usd_max, usd_min) IS NULL THEN 50 WHEN coalesce(usd_max, usd_min) >= 150000 THEN 100 ELSE 20 END
      + 10 * CASE WHEN pref THEN 100 WHEN cen THEN 70 ELSE 40 END) / 100.0::DOUBLE + 0.5))) AS INTEGER) AS score, pref AS company_preferred
  FROM (SELECT *, {_company('company')} IN {_in(RULES.preferred)} AS pref, {_company('company')} IN {_in(RULES.centre_seeds)} AS cen FROM decided WHERE outcome = 'shortlisted')
)"""

QUERIES = {f.__name__: f for f in (
    filter_first_reason, filter_funnel, filter_explain_steps, run_summary, best_copy_per_key, keep_first_per_id, keep_first_per_text, keep_first_per_url, final_scores, shortlist_cap, daily_ranking,
    currency_convert, retained_outcomes, insert_if_absent, insert_if_absent_whole, insert_report, insert_report_whole, purge_retention, reset_for_reevaluation, company_upsert, company_upsert_whole,
    fetch_report)}

ORACLE = {
    "filter_first_reason": EVALUATED + " SELECT id, passed, reason, notes, region, hub_centre, round(usd_min, 4) AS usd_min, round(usd_max, 4) AS usd_max FROM evaluated",
    "filter_funnel": DECIDED + " SELECT source, outcome, count(*) AS n FROM decided GROUP BY ALL",
    "filter_explain_steps": EVALUATED + """, long AS (
        SELECT 1 AS step, 'blocked_company' AS name, NOT blocked AS passed, CASE WHEN blocked THEN 'blocked_company' END AS reason FROM ranked
        UNION ALL SELECT 2, 'age', NOT old, CASE WHEN old THEN 'too_old' END FROM ranked
        UNION ALL SELECT 3, 'title', title_reason IS NULL, title_reason FROM ranked
        UNION ALL SELECT 4, 'location', place_reason IS NULL, place_reason FROM ranked
        UNION ALL SELECT 5, 'salary', salary_reason IS NULL, salary_reason FROM ranked)
        SELECT step, name, passed, reason, count(*) AS n FROM long GROUP BY ALL""",
    "run_summary": DECIDED + """ SELECT count(*) AS evaluated, count(*) FILTER (outcome = 'shortlisted') AS shortlisted, outcome_n.reasons AS reasons FROM decided,
        (SELECT string_agg(outcome || ':' || n, ',' ORDER BY first_id, outcome) AS reasons FROM (SELECT outcome, count(*) AS n, min(id) AS first_id FROM decided WHERE outcome <> 'shortlisted' GROUP BY 1)) outcome_n
        GROUP BY outcome_n.reasons""",
    "best_copy_per_key": f"""WITH postings AS ({ORACLE_POSTINGS}), k AS (SELECT *, {_KEY.format('title')} AS dedupe_key FROM postings)
        SELECT dedupe_key, id AS best_id FROM (SELECT dedupe_key, id, row_number() OVER (PARTITION BY dedupe_key ORDER BY description_is_snippet, length(description) DESC,
        CASE source WHEN 's1' THEN 0 WHEN 's2' THEN 1 WHEN 's3' THEN 2 ELSE 3 END, id) AS rn FROM k) WHERE rn = 1""",
    "keep_first_per_id": f"""SELECT doc_id, norm_md5, source FROM (SELECT doc_id, md5({_norm('text')}) AS norm_md5, source,
        row_number() OVER (PARTITION BY doc_id ORDER BY md5({_norm('text')}), source) AS rn FROM documents) WHERE rn = 1""",
    "keep_first_per_text": f"""SELECT norm_md5, doc_id, source FROM (SELECT md5({_norm('text')}) AS norm_md5, doc_id, source,
        row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "keep_first_per_url": "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "final_scores": SCORED + " SELECT id, pre_score, score, company_preferred FROM scored",
    "shortlist_cap": SCORED + " SELECT id, pre_score, row_number() OVER (ORDER BY pre_score DESC, id) > 100 AS capped FROM scored",
    "daily_ranking": SCORED + """ SELECT CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 5 THEN 'top' ELSE 'extra' END AS section, id, score, company_preferred FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC, company_preferred DESC, coalesce(posted_at, fetched_at) DESC, id) AS rank FROM scored WHERE id % 17 <> 0) WHERE rank <= 15""",
    "currency_convert": f"WITH postings AS ({ORACLE_POSTINGS}) SELECT currency, count(*) AS n, round(sum(salary_min * {_RATE}), 2) AS usd FROM postings GROUP BY 1",
    "insert_if_absent": f"""WITH rows AS ({ORACLE_POSTINGS}), fresh AS (
        SELECT id, source, CASE WHEN id % 33 = 0 THEN NULL ELSE title END AS title, 'new' AS batch FROM rows WHERE id % 4 <> 0)
        SELECT id, source, title, 'old' AS batch FROM rows WHERE id % 2 = 0
        UNION ALL SELECT * FROM fresh WHERE id % 2 <> 0 AND title IS NOT NULL""",
    "insert_report": """SELECT count(*) AS received, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 33 <> 0) AS inserted,
        count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 33 <> 0) AS duplicates, count(*) FILTER (o_orderkey % 33 = 0) AS violations
        FROM orders WHERE o_orderkey % 4 <> 0""",
    "retained_outcomes": DECIDED + """ SELECT id, CASE WHEN outcome = 'shortlisted' AND EXISTS (
        SELECT 1 FROM evaluated k WHERE k.passed AND k.id % 2 = 0 AND k.dedupe_key = d.dedupe_key AND k.id <> d.id) THEN 'duplicate' ELSE outcome END AS outcome FROM decided d""",
    "insert_if_absent_whole": f"""WITH rows AS ({ORACLE_POSTINGS})
        SELECT id, source, title, CASE WHEN id % 2 = 0 THEN 'old' ELSE 'new' END AS batch FROM rows WHERE id % 2 = 0 OR id % 33 <> 0""",
    "insert_report_whole": """SELECT count(*) AS received, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 33 <> 0) AS inserted,
        count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 33 <> 0) AS duplicates, count(*) FILTER (o_orderkey % 33 = 0) AS violations FROM orders""",
    "company_upsert_whole": """SELECT lower(c_name) AS name_key, upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN true END AS is_gcc, CAST(NULL AS BOOLEAN) AS is_preferred,
        CASE WHEN c_custkey % 2 = 0 THEN false END AS is_blocked, CASE WHEN c_custkey % 2 = 0 THEN '2001-01-01' ELSE '2001-08-02' END AS first_seen FROM customer""",
    "purge_retention": """SELECT 's' || substr(o_orderpriority, 1, 1) AS source, count(*) AS kept, CAST(sum(o_orderkey % 1000) AS BIGINT) AS check_sum FROM orders
        WHERE o_orderdate + INTERVAL 1 DAY >= TIMESTAMP '2001-08-02' - INTERVAL 1500 DAY OR o_orderkey % 17 = 0 GROUP BY 1""",
    "reset_for_reevaluation": EVALUATED + """, s AS (SELECT *, CASE WHEN passed AND id % 3 = 0 THEN id % 101 END AS score FROM evaluated)
        SELECT CASE WHEN score IS NULL THEN 'new' ELSE 'shortlisted' END AS status, true AS no_reason, score IS NULL OR usd_max IS NULL AS no_usd, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY 1, 2, 3""",
    "company_upsert": """WITH o AS (SELECT lower(c_name) AS k, c_name AS name, c_custkey % 4 = 0 AS g, false AS p, c_custkey % 10 = 0 AS b FROM customer WHERE c_custkey % 2 = 0),
        n AS (SELECT lower(c_name) AS k, upper(c_name) AS name, c_custkey % 2 = 0 AS given FROM customer WHERE c_custkey % 4 <> 0)
        SELECT k AS name_key, coalesce(n.name, o.name) AS name,
          CASE WHEN n.given THEN true WHEN o.k IS NOT NULL THEN o.g END AS is_gcc, CASE WHEN n.given THEN NULL WHEN o.k IS NOT NULL THEN o.p END AS is_preferred,
          CASE WHEN n.given THEN false WHEN o.k IS NOT NULL THEN o.b END AS is_blocked, CASE WHEN o.k IS NOT NULL THEN '2001-01-01' ELSE '2001-08-02' END AS first_seen
        FROM o FULL OUTER JOIN n USING (k)""",
    "fetch_report": r"""WITH p AS (SELECT 'feed' || (page_id % 6) AS source, page_id % 2 = 0 AS open, url LIKE 'https://%' AS ok,
          regexp_extract(url, '^https://([^/?#:]+)', 1) IN ('blog.tionsh.example.net', 'thther.example.org') AS listed FROM pages),
        r AS (SELECT source, CASE WHEN NOT ok THEN 'invalid_url' WHEN NOT open AND NOT listed THEN 'host' END AS rejection FROM p)
        SELECT s.source, count(r.source) AS fetched, count(r.source) FILTER (rejection IS NULL) AS kept, count(*) FILTER (rejection = 'invalid_url') AS dropped_invalid,
          count(*) FILTER (rejection = 'host') AS dropped_host
        FROM (SELECT 'feed' || i AS source FROM range(8) t(i)) s LEFT JOIN r USING (source) GROUP BY 1""",
}
