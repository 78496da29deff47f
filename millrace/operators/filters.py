"""Ordered rule pipelines over postings.

A rule turns a row into a decision: passed, reason, notes, and derived values
(region, hub_centre, usd_min, usd_max).  ``evaluate`` runs rules in order as
one projection: the first failing rule gives the reason, later rules then count
as not evaluated; notes of evaluated rules are joined, a later non-null derived
value overrides an earlier one.  Nothing is shuffled but for the company
dimension, which is joined on a normalised name.

Row columns: id, title, company, location, description, salary_min,
salary_max, currency, salary_known, salary_is_estimated, posted_at, fetched_at;
``now`` is a parameter, never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.money import to_usd
from millrace.rules import Rules

DECISION = "struct<passed:boolean,reason:string,notes:string,region:string,hub_centre:boolean,usd_min:double,usd_max:double>"
DERIVED = ("region", "hub_centre", "usd_min", "usd_max")


class Rule(Protocol):
    """A pluggable predicate; the order of a list of rules is the API."""

    name: str

    def facts(self, rules: Rules) -> list[dict[str, Column]]:
        """Columns that ``apply`` reads, in stages; computed once per row."""
        ...

    def apply(self, rules: Rules, now: datetime) -> Column: ...


class _NoFacts:
    def facts(self, rules: Rules) -> list[dict[str, Column]]:
        return []


def decision(passed: Column, reason: Column | None = None, notes: Column | None = None, **derived: Column) -> Column:
    """A decision struct; a row fails where ``passed`` is not true."""
    none = F.lit(None)
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(
        ok.alias("passed"), F.when(~ok, reason if reason is not None else F.lit("rejected")).alias("reason"), (notes if notes is not None else none).cast("string").alias("notes"),
        *[derived.get(k, none).cast("string" if k == "region" else "boolean" if k == "hub_centre" else "double").alias(k) for k in DERIVED])


@dataclass(frozen=True)
class BlockedCompany(_NoFacts):
    """Fails for a listed company or one whose row has ``company_blocked``."""

    name: str = "blocked_company"

    def apply(self, rules: Rules, now: datetime) -> Column:
        names = sorted({n for n in map(X.normalise_company_py, rules.blocked) if n})
        listed = X.normalise_company(F.col("company")).isin(*names) if names else F.lit(False)
        return decision(~(F.coalesce(listed, F.lit(False)) | F.coalesce(F.col("company_blocked"), F.lit(False))), F.lit("blocked_company"))


@dataclass(frozen=True)
class Age(_NoFacts):
    """Fails for rows older than the limit; the fetch time stands in for a
    missing posting time, the limit itself passes."""

    name: str = "age"

    def apply(self, rules: Rules, now: datetime) -> Column:
        at = F.coalesce("posted_at", "fetched_at")
        return decision(at >= F.lit(now) - F.make_dt_interval(F.lit(rules.posted_within_days)), F.lit("too_old"))


@dataclass(frozen=True)
class Title:
    """Ordered phrase tests on the title; see ``title_reason``."""

    name: str = "title"

    def facts(self, rules: Rules) -> list[dict[str, Column]]:
        return [{"_title_reason": title_reason(F.col("title"), rules)}]

    def apply(self, rules: Rules, now: datetime) -> Column:
        return decision(F.col("_title_reason").isNull(), F.col("_title_reason"))


@dataclass(frozen=True)
class Location:
    """Hub cities, then region eligibility; see ``location_decision``."""

    name: str = "location"

    def facts(self, rules: Rules) -> list[dict[str, Column]]:
        return location_facts(rules)

    def apply(self, rules: Rules, now: datetime) -> Column:
        return location_decision(rules)


@dataclass(frozen=True)
class Salary:
    """Fails for a known salary whose ceiling is under the floor."""

    name: str = "salary"

    def facts(self, rules: Rules) -> list[dict[str, Column]]:
        code = F.upper(F.trim(F.coalesce("currency", F.lit(""))))
        return [{"_code": code}, {"_usd_min": to_usd(F.col("salary_min"), F.col("_code"), rules.rates), "_usd_max": to_usd(F.col("salary_max"), F.col("_code"), rules.rates)}]

    def apply(self, rules: Rules, now: datetime) -> Column:
        return salary_decision(rules)


def title_reason(title: Column, rules: Rules) -> Column:
    """null if the title passes, else the first reason in rule order."""
    allowed = X.remove_phrases(X.primary_segment(title), rules.allow_phrases)
    wanted = [*rules.include_keywords, *[p for p in map(X.role_phrase, rules.roles) if p]]
    return (
        F.when(X.contains_any(title, [*rules.exclude_keywords, *rules.exclude_roles, *rules.exclude_anywhere]), "title_excluded")
        .when(X.contains_any(allowed, rules.exclude_functions), "title_excluded")
        .when(~X.contains_any(title, wanted), "title_no_match")
        .when(X.contains_any(title, rules.exclude_employment), "employment_type"))


# Words of remote and on-site work, and phrases that restrict where one may live.
REMOTE_WORDS = ("remote", "remotely", "wfh", "work from home", "distributed")
REMOTE_HINTS = ("remote", "work from home", "wfh", "work from anywhere", "fully remote", "remote-first")
ONSITE_WORDS = ("onsite", "on-site", "on site", "in office", "in-office", "in person", "in-person", "hybrid")
RESTRICTIONS = (
    ("must be located in", r"(?i)must be located in"),
    ("must reside in", r"(?i)must reside in"),
    ("must live in", r"(?i)must live in"),
    ("authorized to work in", r"(?i)authorized to work in the (?:US|USA|UK|EU|Canada)"),
    ("residents only", r"(?i)\b(?:US|USA|UK|EU|Canada)\s+(?:only|residents only|based only)\b"),
    ("only candidates", r"(?i)only candidates (?:located|based) in"),
    ("time zone", r"(?i)\b(?:EST|PST|CST|CET|GMT)\b[^a-zA-Z]{0,40}(?:overlap|hours)\b"),
    ("time zone", r"(?i)\b(?:overlap|hours)\b[^a-zA-Z]{0,40}\b(?:EST|PST|CST|CET)\b"),
)
EXCERPT, CENTRE_EXCERPT, WINDOW, LABEL_AFTER, NOTE = 1500, 2000, 80, 40, 40


def first_term(c: Column, terms: Sequence[str]) -> Column:
    """The first listed term that a text holds, or null."""
    out = F.lit(None).cast("string")
    for t in reversed(terms):
        out = F.when(X.contains_term(c, t), t).otherwise(out)
    return out


def description_restriction(description: Column, rules: Rules) -> Column:
    """Label of the first restricting phrase whose first hit in the excerpt has
    no open term nearby, or null.  A pattern's place and hit are evaluated once
    per text, and what stands near it only where it hit."""
    excerpt = F.substring(description, 1, EXCERPT)

    def of(label: str, pattern: str) -> Column:
        def judge(h: Column) -> Column:
            start = F.greatest(F.lit(1), h["at"] - WINDOW)
            near = F.substring(excerpt, start, h["at"] + h["size"] + WINDOW - start)
            snippet = F.substring(description, h["at"], h["size"] + LABEL_AFTER)
            return F.when(~X.contains_any(near, rules.open_terms), F.coalesce(first_term(snippet, rules.restricted_terms), F.lit(label)))

        size = F.length(F.regexp_extract(excerpt, pattern, 0))
        return X.bound(F.regexp_instr(excerpt, F.lit(pattern)), lambda at: F.when(at > 0, X.bound(F.struct(at.alias("at"), size.alias("size")), judge)))

    return F.coalesce(*[of(label, X.ascii_edges(pattern)) for label, pattern in RESTRICTIONS])


def description_facts(description: Column, rules: Rules) -> Column:
    """struct(restriction, remote, centre, length): what the rules read from a
    description.  Texts that many postings share are best judged before they are
    joined to them; a column ``description_facts`` is taken as given."""
    text = F.coalesce(description, F.lit(""))
    plain = [k for k in rules.centre_keywords if X.normalise_py(k) != "gcc"]
    excerpt = X.normalise(F.substring(text, 1, CENTRE_EXCERPT))
    centre = X.bound(excerpt, lambda e: X.contains_any(e, plain) | (X.contains_centre_token(e) if len(plain) < len(rules.centre_keywords) else F.lit(False)))
    return F.struct(
        description_restriction(text, rules).alias("restriction"), X.contains_any(F.substring(text, 1, EXCERPT), REMOTE_HINTS).alias("remote"), centre.alias("centre"),
        F.length(description).alias("length"))


def region_facts(location: Column, rules: Rules) -> dict[str, Column]:
    """What ``classify_region`` decides by."""
    return {
        "_open": X.contains_any(location, rules.open_terms),
        "_onsite": X.contains_any(location, ONSITE_WORDS) & ~X.contains_any(location, REMOTE_WORDS),
        "_left": X.remove_phrases(F.translate(X.normalise(location), "|/()-,;", "       "), rules.generic_words),
        "_term": first_term(location, rules.restricted_terms),
        "_described": F.col("description_facts.restriction"),
    }


def classify_region() -> Column:
    """struct(region, term, named_place, onsite) from ``region_facts``: open,
    restricted or unknown.

    In order: an open term; on-site words without remote words; a place name
    left over when generic words are removed; a restricted term; a restriction
    in the description; unknown."""
    made = lambda region, term=None, named=False, site=False: F.struct(
        F.lit(region).alias("region"), (term if term is not None else F.lit(None)).cast("string").alias("term"), F.lit(named).alias("named_place"), F.lit(site).alias("onsite"))
    left = F.col("_left")
    return (
        F.when(F.col("_open"), made("open"))
        .when(F.col("_onsite"), made("restricted", site=True))
        .when(F.length(F.regexp_replace(left, "[^a-z]", "")) >= 2, made("restricted", F.substring(left, 1, NOTE), named=True))
        .when(F.col("_term").isNotNull(), made("restricted", F.col("_term")))
        .when(F.col("_described").isNotNull(), made("restricted", F.col("_described")))
        .otherwise(made("unknown")))


def is_centre(company: Column, rules: Rules, flagged: Column | None = None, described: Column | None = None) -> Column:
    """Whether a company is a capability centre: a seed phrase or equal name, a
    flag of the company dimension, or a keyword in name or description."""
    names = sorted({n for n in map(X.normalise_company_py, rules.centre_seeds) if n})
    out = X.contains_any(company, rules.centre_seeds)
    if names:
        out = out | F.coalesce(X.normalise_company(company).isin(*names), F.lit(False))
    if flagged is not None:
        out = out | F.coalesce(flagged, F.lit(False))
    plain = [k for k in rules.centre_keywords if X.normalise_py(k) != "gcc"]
    out = out | X.contains_any(company, plain)
    if described is not None:
        out = out | described
    return out | X.contains_centre_token(company) if len(plain) < len(rules.centre_keywords) else out


def location_facts(rules: Rules) -> list[dict[str, Column]]:
    title, place = F.col("title"), F.col("location")
    hubs = [rules.place_aliases.get(h, h) for h in map(X.normalise_py, rules.hub_cities)]
    return [
        {
            **region_facts(place, rules),
            "_hub": X.contains_any(X.fold_aliases(place, rules.place_aliases), hubs),
            "_remote": X.contains_any(title, REMOTE_HINTS) | X.contains_any(place, REMOTE_HINTS) | F.col("description_facts.remote"),
            "_centre": is_centre(F.col("company"), rules, F.col("company_is_centre"), F.col("description_facts.centre")),
            "_away": ~X.contains_any(place, REMOTE_WORDS) & ~X.contains_any(title, REMOTE_WORDS),
        },
        {"_area": classify_region()},
    ]


def location_decision(rules: Rules) -> Column:
    area, yes, no = F.col("_area"), F.lit(True), F.lit(False)
    rejected_hub = ~F.col("_remote") & ~F.col("_centre") if rules.hub_centres_only else no
    restricted = area["region"] == "restricted"
    elsewhere = area["onsite"] | (area["named_place"] & F.col("_away"))
    passed = F.when(F.col("_hub"), ~rejected_hub).otherwise(~restricted)
    reason = F.when(F.col("_hub"), "not_gcc").when(elsewhere, "onsite_other_location").otherwise("region_restricted")
    notes = F.when(F.col("_hub") & F.col("_remote"), "hub_remote").when(~F.col("_hub") & restricted, area["term"])
    region = F.when(F.col("_hub"), F.when(F.col("_remote"), "open").when(~rejected_hub, "unknown")).otherwise(area["region"])
    return decision(passed, reason, notes, region=region, hub_centre=F.col("_hub") & ~F.col("_remote") & ~rejected_hub & yes)


def salary_decision(rules: Rules) -> Column:
    low, high, usd_min, usd_max = F.col("salary_min"), F.col("salary_max"), F.col("_usd_min"), F.col("_usd_max")
    vague = ~F.coalesce(F.col("salary_known"), F.lit(False)) | F.coalesce(F.col("salary_is_estimated"), F.lit(False)) | (F.col("_code") == "")
    inr = F.col("_code") == "INR"
    unknown = vague | (~inr & usd_min.isNull() & usd_max.isNull())
    under_inr = F.coalesce(F.coalesce(high, low) < F.lit(rules.min_salary_inr).cast("double"), F.lit(False))
    under = F.when(inr, under_inr).otherwise(F.coalesce(F.coalesce(usd_max, usd_min) < rules.min_salary_usd, F.lit(False)))
    return decision(unknown | ~under, F.lit("salary_below_min"), F.when(unknown, "salary_unknown"), usd_min=F.when(~unknown, usd_min), usd_max=F.when(~unknown, usd_max))


STANDARD: tuple[Rule, ...] = (BlockedCompany(), Age(), Title(), Location(), Salary())


def with_companies(postings: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Add company_blocked, company_is_centre, company_preferred.

    The dimension (name, is_blocked, is_gcc, is_preferred) is reduced to one row
    per normalised name first, so the join never multiplies postings; Spark
    broadcasts it if it is small."""
    if companies is None:
        return postings.withColumns({c: F.lit(False) for c in ("company_blocked", "company_is_centre", "company_preferred")})
    flags = companies.groupBy(X.normalise_company(F.col("name")).alias("_key")).agg(
        F.bool_or("is_blocked").alias("company_blocked"), F.bool_or("is_gcc").alias("company_is_centre"), F.bool_or("is_preferred").alias("company_preferred"))
    return postings.withColumn("_key", X.normalise_company(F.col("company"))).join(flags, "_key", "left").drop("_key")


def with_decisions(postings: DataFrame, rules: Rules, now: datetime, order: Sequence[Rule]) -> DataFrame:
    """``postings`` plus one decision column ``_d0``, ``_d1``, ... per rule.

    Facts are columns of their own, so that a pattern runs once per row however
    often its outcome is read; those of descriptions come first."""
    if "description_facts" not in postings.columns:
        postings = postings.withColumn("description_facts", description_facts(F.col("description"), rules))
    for rule in order:
        for stage in rule.facts(rules):
            postings = postings.withColumns(stage)
    return postings.withColumns({f"_d{i}": r.apply(rules, now) for i, r in enumerate(order)})


def evaluate(postings: DataFrame, rules: Rules, now: datetime, order: Sequence[Rule] = STANDARD) -> DataFrame:
    """``postings`` plus passed, reason, notes and the derived values."""
    out = with_decisions(postings, rules, now, order)
    ok = [F.col(f"_d{i}.passed") for i in range(len(order))]
    out = out.withColumn("_stop", F.coalesce(*[F.when(~p, i) for i, p in enumerate(ok)], F.lit(len(order))))
    seen = lambda i, k: F.when(F.col("_stop") >= i, F.col(f"_d{i}.{k}"))
    every = range(len(order))
    derived = {k: F.coalesce(*[seen(i, k) for i in reversed(every)]) for k in DERIVED}
    out = out.withColumns({
        "passed": F.col("_stop") == len(order), "reason": F.coalesce(*[F.when(F.col("_stop") == i, F.col(f"_d{i}.reason")) for i in every]),
        "notes": F.concat_ws("; ", *[seen(i, "notes") for i in every]), **derived})
    return out.select(*postings.columns, "passed", "reason", "notes", *DERIVED)


def explain(postings: DataFrame, rules: Rules, now: datetime, order: Sequence[Rule] = STANDARD) -> DataFrame:
    """(id, step, name, passed, reason): every rule of every row."""
    out = with_decisions(postings, rules, now, order)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(r.name).alias("name"), F.col(f"_d{i}.passed").alias("passed"), F.col(f"_d{i}.reason").alias("reason")) for i, r in enumerate(order)])
    return out.select("id", F.inline(rows))
