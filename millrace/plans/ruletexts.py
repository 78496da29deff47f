"""Text rules over texts made of table contents.

Each text is made by one SELECT that both engines run; the rules are then applied
by the library on one side and written out in SQL on the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import filters, grounding, replies, scoring
from millrace.rules import Rules
from millrace.runtime import read, spread

TABLES = ("orders", "customer", "nation", "region", "part", "documents")
RULES = Rules()

PLACES_SQL = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 <> 0 THEN CASE o_orderkey % 9 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Onsite' WHEN 3 THEN 'In-Office or remote' WHEN 4 THEN 'Worldwide'
    WHEN 5 THEN 'Fully remote' WHEN 6 THEN '' WHEN 7 THEN 'Anywhere in' ELSE 'wfh/remote' END
  || CASE o_orderkey % 5 WHEN 0 THEN ', ' || n_name WHEN 1 THEN ' (US)' WHEN 2 THEN ' - EU | ' || r_name WHEN 3 THEN ' us, Canada' ELSE '' END END AS place,
  CASE o_orderkey % 4 WHEN 0 THEN 'time zone' END AS restriction
FROM {orders} o JOIN {customer} c ON c_custkey = o_custkey JOIN {nation} n ON n_nationkey = c_nationkey JOIN {region} r ON r_regionkey = n_regionkey
"""
DESCRIPTIONS_SQL = """
SELECT doc_id, substr(text, 1, CAST(20 + doc_id % 1600 AS INT)) || ' ' || CASE doc_id % 12 WHEN 0 THEN 'Must be LOCATED in' WHEN 1 THEN 'you must reside in' WHEN 2 THEN 'must live in' WHEN 3 THEN 'authorized to work in the EU'
    WHEN 4 THEN 'UK residents only' WHEN 5 THEN 'only candidates based in' WHEN 6 THEN 'we keep EST, 4 hours' WHEN 7 THEN 'hours (overlap) of CET' WHEN 8 THEN 'best USA onlyish' WHEN 9 THEN 'must be located in x. Canada only' ELSE 'no rule' END
  || CASE doc_id % 5 WHEN 0 THEN ' worldwide ' WHEN 1 THEN ' the US or EU ' WHEN 2 THEN ' europe ' ELSE ' ' END || substr(text, 30, CAST(doc_id % 90 AS INT)) || CASE doc_id % 7 WHEN 0 THEN ' anywhere' ELSE '' END AS text
FROM {documents} d
"""
TITLES_SQL = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'US: ' WHEN 1 THEN 'us (x) ' WHEN 2 THEN 'GCC - ' WHEN 3 THEN 'gcc region ' WHEN 4 THEN 'Bengaluru, ' WHEN 5 THEN 'USA ' WHEN 6 THEN 'join us | ' ELSE '' END || p_name
  || CASE p_partkey % 5 WHEN 0 THEN ' – ' || p_type WHEN 1 THEN '/gcc countries' WHEN 2 THEN ' for US-' || p_brand WHEN 3 THEN '_Bengaluru gcc' ELSE '' END AS t
FROM {part} p
"""
VERSIONS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' || (o_orderkey % 7) WHEN 2 THEN (o_orderkey % 5) || '.' || (o_orderkey % 3) WHEN 3 THEN 'x' WHEN 4 THEN 'v' || o_orderkey % 2 ELSE '1' || (o_orderkey % 4) END AS v FROM {orders} o"
_WORDS = [*grounding.UNITS, *grounding.SCALES, "and", "stone", "users", "year"]
_WORD = lambda e: f"CASE {e} % {len(_WORDS)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END"
NUMBERS_SQL = (
    f"SELECT o_orderkey AS id, {_WORD('o_orderkey')} || CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN ' ' WHEN 2 THEN ', ' ELSE ' - ' END || {_WORD('(o_orderkey * 7 + 3)')} || CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '; ' ELSE '  ' END"
    f" || {_WORD('(o_orderkey * 11 + 5)')} || ' One ' || {_WORD('(o_orderkey * 5 + 1)')} || CASE o_orderkey % 2 WHEN 0 THEN 'th' ELSE ' ' || o_orderpriority END AS t FROM {{orders}} o")
DETAILS_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'oops' WHEN 1 THEN NULL ELSE '{{"version":1' || CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ',"unscored":true' WHEN 2 THEN ',"unscored":true' ELSE ',"unscored":false' END
  || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ',"skillsFit":' || (o_orderkey % 101) END || CASE o_orderkey % 4 WHEN 0 THEN ',"failedAttempts":' || (o_orderkey % 5) ELSE '' END || CASE o_orderkey % 5 WHEN 0 THEN ',"unscoredFinal":true' ELSE '' END
  || CASE o_orderkey % 6 WHEN 0 THEN ',"missingSkills":["' || o_orderpriority || '","x"]' WHEN 1 THEN ',"missingSkills":["a"]' ELSE '' END || '}}' END AS t FROM {orders} o
"""


def _made(spark, sf_dir, sql, *tables):
    return spark.sql(sql, **{t: spread(read(spark, sf_dir, t)) for t in tables})


def region_classes(spark, sf_dir):
    """Regions of places, with on-site words and left-over place names."""
    rows = _made(spark, sf_dir, PLACES_SQL, "orders", "customer", "nation", "region").select("id", "place", F.struct("restriction").alias("description_facts"))
    area = rows.select("id", *[c.alias(k) for k, c in filters.region_facts(F.col("place"), RULES).items()]).select("id", filters.classify_region().alias("a"))
    return area.select("id", "a.region", "a.term", "a.named_place", "a.onsite")


def description_restrictions(spark, sf_dir):
    """Labels of restricting phrases in texts of documents."""
    return _made(spark, sf_dir, DESCRIPTIONS_SQL, "documents").select("doc_id", filters.description_restriction(F.col("text"), RULES).alias("label"))


def phrase_kinds(spark, sf_dir):
    """Abbreviations with their case, the gcc token, folded places and first
    segments of texts."""
    return _made(spark, sf_dir, TITLES_SQL, "part").select(
        "p_partkey", X.contains_term(F.col("t"), "US").alias("abbreviation"), X.contains_centre_token(F.col("t")).alias("gcc"),
        X.fold_aliases(F.col("t"), {"bengaluru": "bangalore"}).alias("folded"), X.primary_segment(F.col("t")).alias("segment"))


def stale_versions(spark, sf_dir):
    rows, v = _made(spark, sf_dir, VERSIONS_SQL, "orders"), F.col("v")
    return rows.select("id", scoring.is_stale(v, "3").alias("numeric"), scoring.is_stale(v, "3", False).alias("any"), scoring.is_stale(v, "x", False).alias("text"))


def number_words(spark, sf_dir):
    show = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _made(spark, sf_dir, NUMBERS_SQL, "orders").select("id", show(grounding.number_words(F.col("t"))).alias("claims"), show(grounding.number_words(F.col("t"), claims=False)).alias("every"))


def score_details(spark, sf_dir):
    rows = _made(spark, sf_dir, DETAILS_SQL, "orders").select("id", replies.read_details(F.col("t")).alias("d"), F.size(replies.missing_skills(F.col("t"))).alias("missing"))
    again = replies.read_details(replies.write_details(F.col("d")))
    return rows.select("id", "d.unscored", F.col("d.failedAttempts").alias("failed"), F.col("d.unscoredFinal").alias("final"), "missing", again.eqNullSafe(F.col("d")).alias("round_trip"))


QUERIES = {f.__name__: f for f in (region_classes, description_restrictions, phrase_kinds, stale_versions, number_words, score_details)}


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _bounded(core: str) -> str:
    return f"(^|[^0-9A-Za-z])({core})([^0-9A-Za-z]|$)"


def _any(x: str, phrases) -> str:
    """Whether a text holds one of some phrases, bounded."""
    return f"coalesce(regexp_matches({_norm(x)}, '{_bounded('|'.join(X.normalise_py(p) for p in phrases))}'), false)"


def _term(x: str, terms) -> str:
    """The first of some terms that a text holds."""
    held = [f"WHEN regexp_matches({x}, '{_bounded(t)}') THEN '{t}'" if t in X.ABBREVIATIONS else f"WHEN {_any(x, [t])} THEN '{t}'" for t in terms]
    return f"CASE {' '.join(held)} END"


def _without(x: str, phrases) -> str:
    """A text without some phrases, longest first; neighbours share their edge, so each goes twice."""
    out = x
    for p in sorted(phrases, key=len, reverse=True):
        once = lambda y, p=p: rf"regexp_replace({y}, '{_bounded(X.normalise_py(p))}', '\1 \3', 'g')"
        out = rf"trim(regexp_replace({once(once(out))}, '\s+', ' ', 'g'))"
    return out


def _sql(made: str) -> str:
    return made.format(**{t: t for t in TABLES})


_RESTRICTED = ", ".join(rf"""(SELECT CASE WHEN len(s) > 1 AND NOT {_any('substr(excerpt, greatest(1, length(s[1]) + 1 - 80), length(s[1]) + 1 + length(h) + 80 - greatest(1, length(s[1]) + 1 - 80))', RULES.open_terms)}
    THEN coalesce({_term('substr(text, length(s[1]) + 1, length(h) + 40)', RULES.restricted_terms)}, '{label}') END FROM (SELECT string_split_regex(excerpt, '{p}') AS s, regexp_extract(excerpt, '{p}') AS h))""" for label, p in filters.RESTRICTIONS)
_IS_WORD = "p IN (" + ", ".join(f"'{w}'" for w in [*grounding.UNITS, *grounding.SCALES]) + ")"
_VALUE = "CASE p " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in {**grounding.UNITS, **grounding.SCALES}.items()) + " END"
ORACLE = {
    "region_classes": f"""WITH made AS ({_sql(PLACES_SQL)}), facts AS (SELECT id, restriction, {_any('place', RULES.open_terms)} AS is_open, {_any('place', filters.ONSITE_WORDS)} AND NOT {_any('place', filters.REMOTE_WORDS)} AS site,
          {_without(_norm(f"translate({_norm('place')}, '|/()-,;', '       ')"), RULES.generic_words)} AS left_over, {_term('place', RULES.restricted_terms)} AS term FROM made),
        named AS (SELECT *, coalesce(length(regexp_replace(left_over, '[^a-z]', '', 'g')) >= 2, false) AS named FROM facts)
        SELECT id, CASE WHEN is_open THEN 'open' WHEN site OR named OR term IS NOT NULL OR restriction IS NOT NULL THEN 'restricted' ELSE 'unknown' END AS region,
          CASE WHEN is_open OR site THEN NULL WHEN named THEN substr(left_over, 1, 40) ELSE coalesce(term, restriction) END AS term, NOT is_open AND NOT site AND named AS named_place, NOT is_open AND site AS onsite FROM named""",
    "description_restrictions": f"WITH made AS ({_sql(DESCRIPTIONS_SQL)}), cut AS (SELECT doc_id, text, substr(text, 1, 1500) AS excerpt FROM made) SELECT doc_id, coalesce({_RESTRICTED}) AS label FROM cut",
    "phrase_kinds": rf"""WITH made AS ({_sql(TITLES_SQL)}) SELECT p_partkey, regexp_matches(t, '{_bounded("US")}') AS abbreviation, regexp_matches(regexp_replace({_norm('t')}, 'gcc( countries| region)', '_', 'g'), '{_bounded("gcc")}') AS gcc,
        replace({_norm('t')}, 'bengaluru', 'bangalore') AS folded, trim(regexp_extract(t, '(?s)^(.*?)([,:|(]| [-–—] |$)', 1)) AS segment FROM made""",
    "stale_versions": f"""WITH made AS ({_sql(VERSIONS_SQL)}), r AS (SELECT id, v, TRY_CAST(v AS DOUBLE) AS d FROM made)
        SELECT id, coalesce(d < 3, true) AS numeric, CASE WHEN d IS NOT NULL THEN d < 3 ELSE coalesce(v <> '3', true) END AS "any", coalesce(v <> 'x', true) AS text FROM r""",
    "number_words": rf"""WITH made AS ({_sql(NUMBERS_SQL)}), listed AS (SELECT id, regexp_extract_all(lower(t), '[a-z]+|[\s-]+|[^a-z\s-]+') AS ps FROM made), pieces AS (SELECT id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM listed),
        told AS (SELECT *, {_IS_WORD} AS is_word, NOT {_IS_WORD} AND NOT regexp_matches(p, '^[\s-]') AS breaks FROM pieces), runs AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM told),
        found AS (SELECT id, run, min(i) AS i, max(i) AS last, string_agg(p, ' ' ORDER BY i) AS words, list_reduce(list_prepend({{'total': 0::BIGINT, 'now': 0::BIGINT}}, list({{'total': ({_VALUE})::BIGINT, 'now': (CASE WHEN p = 'hundred' THEN 1 WHEN p IN ('thousand', 'million') THEN 2 ELSE 0 END)::BIGINT}} ORDER BY i)),
            lambda a, w: {{'total': CASE WHEN w.now = 2 THEN a.total + (CASE WHEN a.now = 0 THEN 1 ELSE a.now END) * w.total ELSE a.total END, 'now': CASE w.now WHEN 0 THEN a.now + w.total WHEN 1 THEN (CASE WHEN a.now = 0 THEN 1 ELSE a.now END) * w.total ELSE 0 END}}) AS s
          FROM runs WHERE is_word GROUP BY id, run),
        after AS (SELECT f.*, s.total + s.now AS n, (SELECT arg_min(q.p, q.i) FROM pieces q WHERE q.id = f.id AND q.i > f.last AND regexp_matches(q.p, '^[a-z]')) AS next FROM found f)
        SELECT m.id, coalesce(string_agg(n, ',' ORDER BY i) FILTER (words <> 'one' OR next IN ({", ".join(f"'{w}'" for w in grounding.COUNTED)})), '') AS claims, coalesce(string_agg(n, ',' ORDER BY i), '') AS every
        FROM made m LEFT JOIN after a USING (id) GROUP BY m.id""",
    "score_details": f"""WITH made AS ({_sql(DETAILS_SQL)}), j AS (SELECT id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM made),
        r AS (SELECT id, j, CAST(j ->> '$.unscored' AS BOOLEAN) AS u, coalesce((j ->> '$.unscored') IS NOT NULL AND (CAST(j ->> '$.unscored' AS BOOLEAN) OR (j ->> '$.skillsFit') IS NOT NULL), false) AS ok FROM j)
        SELECT id, CASE WHEN ok THEN u END AS unscored, CASE WHEN ok THEN coalesce(CAST(j ->> '$.failedAttempts' AS INTEGER), 0) END AS failed, CASE WHEN ok THEN coalesce(CAST(j ->> '$.unscoredFinal' AS BOOLEAN), false) END AS final,
          CASE WHEN ok AND NOT u THEN coalesce(json_array_length(j -> '$.missingSkills'), 0)::INTEGER ELSE 0 END AS missing, true AS round_trip FROM r""",
}
