"""The driver's tables read as postings, in Spark and in SQL.

One SELECT serves both engines; Spark gets the tables as frames, other engines
as views of the same names.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.filters import description_facts
from millrace.rules import Rules
from millrace.runtime import read, spread

TABLES = ("orders", "part", "customer", "nation", "region", "documents")
NOW = datetime(2001, 8, 2)

POSTINGS_SQL = """
SELECT o.o_orderkey AS id, '' || o.o_orderkey AS external_id, 's' || substr(o.o_orderpriority, 1, 1) AS source,
       p.p_type || ' ' || p.p_name AS title, c.c_name AS company, n.n_name || ', ' || r.r_name AS location,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_totalprice END AS salary_min,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_totalprice * CAST(1.2 AS DOUBLE) END AS salary_max,
       CASE o.o_orderkey % 8 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CAD' WHEN 4 THEN 'AUD' WHEN 5 THEN 'SGD' WHEN 6 THEN 'AED' ELSE 'XXX' END AS currency,
       o.o_orderkey % 7 <> 0 AS salary_known, o.o_orderkey % 13 = 0 AS salary_is_estimated,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderdate END AS posted_at,
       o.o_orderdate + INTERVAL '1' DAY AS fetched_at,
       d.text AS description, {extra}o.o_orderstatus = 'P' AS description_is_snippet
FROM {orders} o
JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
LEFT JOIN {documents} d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM {documents})
"""
ORACLE_POSTINGS = POSTINGS_SQL.format(extra="", **{t: t for t in TABLES})


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with what the rules read from them."""
    return spread(read(spark, sf_dir, "documents")).withColumn("facts", description_facts(F.col("text"), RULES))


def postings(spark: SparkSession, sf_dir: str, **instead: DataFrame) -> DataFrame:
    """The derived postings; what the rules read from a description is found once
    per document, before many postings share it.  ``instead`` replaces tables,
    for example by a stream of orders."""
    tables = {t: read(spark, sf_dir, t) for t in TABLES} | {"documents": described(spark, sf_dir)} | instead
    df = spark.sql(POSTINGS_SQL.replace("{extra}", "d.facts AS description_facts, "), **tables)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "fetched_at")})


#: Rules for the derived titles, places and companies.
RULES = Rules(
    exclude_keywords=("promo",), exclude_roles=("Small Cold",), exclude_anywhere=("anvil",), allow_phrases=("standard hot", "standard new"),
    exclude_functions=("standard",), include_keywords=("gear", "bolt", "widget", "rod", "plate"), roles=("Senior Large Old", "sr blue ring"),
    exclude_employment=("rod",), open_terms=("nation 1", "nation 2", "nation 7"), restricted_terms=("nation 3", "nation 9"),
    generic_words=("nation", "africa", "america", "asia", "europe", "middle east"), hub_cities=("nation 4",), hub_centres_only=True,
    centre_seeds=("Customer#000000012", "Customer#000000013"), centre_keywords=("gcc",),
    blocked=("Customer#000000003", "Customer 000000005"), preferred=("Customer#000000007", "Customer#000000011", "Customer#000000019"),
    posted_within_days=1200, min_salary_usd=150_000.0, max_shortlist=100)
SOURCE_ORDER = ["s1", "s2", "s3"]
