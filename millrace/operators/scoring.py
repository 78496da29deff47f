"""Pre-scores, sub-scores, final scores and rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.operators.filters import is_centre
from millrace.rules import Rules

# Points of the pre-score and levels of the sub-scores.
POINTS = {"preferred": 30, "role": 25, "recent": 20, "salary": 15, "full_text": 10, "hub_centre": 20, "open_region": 10}
LOCATION, SALARY, COMPANY = (100, 90, 60), (100, 50, 20), (100, 70, 40)


def is_preferred(company: Column, rules: Rules, flagged: Column | None = None) -> Column:
    names = sorted({n for n in map(X.normalise_company_py, rules.preferred) if n})
    out = F.coalesce(X.normalise_company(company).isin(*names), F.lit(False)) if names else F.lit(False)
    return out | F.coalesce(flagged, F.lit(False)) if flagged is not None else out


def pre_score(rules: Rules, now: datetime) -> Column:
    """Additive points that decide who stays under a cap."""
    roles = [p for p in map(X.role_phrase, rules.roles) if p]
    tests = {
        "preferred": is_preferred(F.col("company"), rules, F.col("company_preferred")),
        "role": X.contains_any(F.col("title"), roles),
        "recent": F.coalesce("posted_at", "fetched_at") >= F.lit(now) - F.make_dt_interval(F.lit(2)),
        "salary": F.col("usd_max") >= rules.min_salary_usd,
        "full_text": ~F.col("description_is_snippet"),
        "hub_centre": F.col("hub_centre"),
        "open_region": F.col("region") == "open",
    }
    return sum((F.when(F.coalesce(c, F.lit(False)), POINTS[k]).otherwise(0) for k, c in tests.items()), F.lit(0)).cast("int")


def location_score() -> Column:
    return F.when(F.col("region") == "open", LOCATION[0]).when(F.coalesce("hub_centre", F.lit(False)), LOCATION[1]).otherwise(LOCATION[2])


def salary_score(rules: Rules) -> Column:
    code, ceiling = F.upper(F.trim(F.coalesce("currency", F.lit("")))), F.coalesce("usd_max", "usd_min")
    unknown = ~F.coalesce(F.col("salary_known"), F.lit(False)) | F.coalesce(F.col("salary_is_estimated"), F.lit(False)) | code.isin("", "INR") | ceiling.isNull()
    return F.when(unknown, SALARY[1]).when(ceiling >= rules.min_salary_usd, SALARY[0]).otherwise(SALARY[2])


def company_score(rules: Rules) -> Column:
    """By the company's name alone."""
    centre = is_centre(F.col("company"), rules, F.col("company_is_centre"))
    return F.when(is_preferred(F.col("company"), rules, F.col("company_preferred")), COMPANY[0]).when(centre, COMPANY[1]).otherwise(COMPANY[2])


def final_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean, .5 rounded up, within 0..100."""
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    mean = sum((parts[k].cast("double") * float(w) for k, w in weights.items()), F.lit(0.0)) / total
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(mean + 0.5))).cast("int")


def is_stale(stored: Column, current: str, numeric: bool = True) -> Column:
    """Whether a stored version is missing, unreadable or older.

    Numeric: an unreadable current version makes nothing stale.  Otherwise text
    that is no number is compared as text."""
    have = stored.try_cast("double")
    try:
        want: float | None = float(current)
    except ValueError:
        want = None
    if numeric:
        return F.lit(False) if want is None else F.coalesce(have < want, F.lit(True))
    if want is None:
        return F.coalesce(stored != current, F.lit(True))
    return F.when(have.isNotNull(), have < want).otherwise(F.coalesce(stored != current, F.lit(True)))


def cap(passed: DataFrame, limit: int, score: str = "pre_score") -> DataFrame:
    """``passed`` plus ``capped``: false for the best ``limit`` rows by score
    and id.  The cut-off row comes from a top-k, not from a global sort; the
    comparison with it needs no join."""
    order = F.struct((-F.col(score)).alias("s"), F.col("id").alias("i"))
    top = passed.select(order.alias("o")).orderBy("o").limit(limit)
    edge = top.agg(F.max("o").alias("edge"))
    return passed.join(F.broadcast(edge)).withColumn("capped", F.coalesce(order > F.col("edge"), F.lit(True))).drop("edge")


def rank_list(pool: DataFrame, sent: DataFrame, rules: Rules) -> DataFrame:
    """Ranked rows with rank and section (top, extra).

    Rows already sent (by id) leave; at least ``min_score``; by score, preferred
    company, effective time, id.  Only the first top + extra rows are numbered."""
    left = pool.join(sent.select("id").distinct(), "id", "left_anti").where(F.col("score") >= rules.min_score)
    left = left.withColumn("effective_at", F.coalesce("posted_at", "fetched_at"))
    order = [F.desc("score"), F.desc("company_preferred"), F.desc("effective_at"), F.asc("id")]
    first = left.orderBy(*order).limit(rules.top_count + rules.extra_count)
    numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over the few rows that are left
    return numbered.withColumn("section", F.when(F.col("rank") <= rules.top_count, "top").otherwise("extra"))


def first_valid_attempt(replies: DataFrame, keys: list[str], attempt: str = "attempt", valid: str = "valid") -> DataFrame:
    """Per key the first valid reply, else the last one."""
    whole = F.struct(*[F.col(c) for c in replies.columns])
    good = F.min_by(F.when(F.col(valid), whole), F.when(F.col(valid), F.col(attempt)))
    return replies.groupBy(*keys).agg(F.coalesce(good, F.max_by(whole, attempt)).alias("r")).select("r.*")


def attempt_counts(events: DataFrame, keys: list[str], order: list[str], success: str = "success", limit: int = 3) -> DataFrame:
    """Failures in a row up to each event and whether they reach ``limit``; a
    success starts anew."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = events.withColumn("_island", F.sum(F.col(success).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_island = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("failed_attempts", F.sum((~F.col(success)).cast("int")).over(in_island))
    return out.withColumn("final", F.col("failed_attempts") >= limit).drop("_island")


def assemble(postings: DataFrame, replies: DataFrame, weights: dict[str, float], limit: int = 3) -> DataFrame:
    """id, score, unscored, failed_attempts, unscored_final, notes of each posting
    (id, location_score, salary_score, company_score, description_is_snippet,
    failed_attempts) with its reply (id, skills_fit, seniority_fit, valid).

    A valid reply gives the weighted score of rounded judgements; any other, or
    none, is one more failed attempt."""
    both = postings.join(replies.select("id", "skills_fit", "seniority_fit", "valid"), "id", "left")
    ok = F.coalesce(F.col("valid"), F.lit(False))
    whole = lambda c: F.floor(F.col(c) + 0.5)
    parts = {"skills": whole("skills_fit"), "seniority": whole("seniority_fit"), "location": F.col("location_score"), "salary": F.col("salary_score"), "company": F.col("company_score")}
    failed = F.when(ok, 0).otherwise(F.coalesce("failed_attempts", F.lit(0)) + 1)
    notes = F.array_compact(F.array(F.when(F.col("description_is_snippet"), "snippet_only"), F.when(~ok, "unscored")))
    return both.select(
        "id", F.when(ok, final_score(parts, weights)).alias("score"), (~ok).alias("unscored"), failed.cast("int").alias("failed_attempts"), (failed >= limit).alias("unscored_final"), notes.alias("notes"))
