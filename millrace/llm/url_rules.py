"""URL rules by a sort-merge range join (operator 12).

A host is written with its labels reversed, each followed by a dot
(``www.a.org`` is ``org.a.www.``): a host and all its subdomains are then the
keys that begin with one key, an interval of the sorted keys.  Such intervals
lie inside or apart from each other, and so do those of path beginnings.

One sorted sweep over rules' starts, rules' ends and urls finds the active
nested intervals of each url: the depth is a running sum over starts and ends,
and the stack holds, per depth, the last start there.  A first sweep along the
hosts gives each url the rule hosts above it, a second one along (rule host,
path) the longest fitting path of each.  Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ordered import in_ranges, scan
from millrace.runtime import cut, discard

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query op12_url_rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_key(host: Column) -> Column:
    """Reversed labels, each with a dot; an empty host stands above all hosts."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))).cast("binary")


def active(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` (key, tie and others) with ``stack``: the ``what`` of all rules
    (key, what) whose key begins the point's, shortest first.

    Keys are binary; rules' keys are distinct; ``tie`` tells points of one key
    apart, so that a frequent key is dealt to several ranges.  Points with a null
    key get an empty stack.
    """
    starts = rules.select("key", F.lit(1).alias("kind"), "what")
    after = F.concat("key", F.lit(bytearray(b"\xff")))  # above all that begins with the key: no text holds this byte
    events = starts.unionByName(rules.select(after.alias("key"), F.lit(0).alias("kind"), "what"))
    ranges = in_ranges(events, ["key", "kind"])
    edges = cut(scan(ranges, ["key", "kind"], sums={"depth": F.when(F.col("kind") == 1, 1).otherwise(-1)}))
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    others = [c for c in points.columns if c not in ("key", "tie")]
    rows = points.select("key", F.lit(2).alias("kind"), "tie", F.struct(*others).alias("row"))
    mixed = in_ranges(rows.unionByName(edges, allowMissingColumns=True), ["key", "kind", "tie"])
    levels = {f"at{d}": F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("what")) for d in range(1, deepest + 1)}
    swept = scan(mixed, ["key", "kind", "tie"], last={"open": F.col("depth"), **levels}).where("kind = 2")
    stack = F.slice(F.array(*levels), F.lit(1), F.coalesce("open", F.lit(0)).cast("int")) if deepest else F.array().cast(f"array<{rules.schema['what'].dataType.simpleString()}>")
    discard(ranges)
    return swept.select("key", "tie", "row.*", stack.alias("stack"))


def canonical(rules: DataFrame) -> DataFrame:
    """(node, host, path, verdict), one row per (host, path): of contradicting
    verdicts ``block`` stands.  Rules with a null part fit nothing, nor do paths
    that are neither empty nor start with a slash."""
    host = F.translate("host", UPPER, LOWER)
    known = rules.where("host is not null and path is not null and verdict in ('allow', 'block') and (path = '' or startswith(path, '/'))")
    return known.groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict")).select(host_key(F.col("host")).alias("node"), "host", "path", "verdict")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains where the
    url's path begins with the rule's.  The longest fitting rule (code points of
    host and path, then the longer host) decides; without one ``default`` does
    and rule is null.  Null urls and urls without ``://`` have an empty host and
    path.  Repeated rows and null keys stay; other columns are not returned.
    """
    rules = cut(canonical(rules))
    urls = pages.select(F.struct(F.col(f"`{key}`").alias("id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")).alias("url"), F.monotonically_increasing_id().alias("tie"))
    hosts = rules.select(F.col("node").alias("key"), F.col("node").alias("what")).distinct()
    above = active(urls.withColumn("key", host_key(F.col("url.host"))), hosts)
    pairs = above.select("url", "tie", F.explode_outer("stack").alias("node")).withColumn("key", F.concat("node", F.col("url.path").cast("binary")))
    what = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "verdict")
    fits = active(pairs.select("key", "tie", "url"), rules.select(F.concat("node", F.col("path").cast("binary")).alias("key"), what.alias("what")))
    longest = fits.select("tie", "url", F.try_element_at("stack", F.lit(-1)).alias("top")).groupBy("tie").agg(F.any_value("url").alias("url"), F.max("top").alias("top"))
    return longest.select(F.col("url.id").alias(key), "url.host", "url.path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def op12_url_rules(pages: DataFrame) -> DataFrame:
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
cuts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
urls AS (SELECT row_number() OVER () AS r, page_id,
           coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cuts),
fits AS (SELECT u.r, u.page_id, u.host, u.path, rhost || rpath AS rule, rverdict,
           row_number() OVER (PARTITION BY u.r ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) AS k
         FROM urls u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
