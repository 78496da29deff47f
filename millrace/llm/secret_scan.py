"""Secret scans with an incremental blob ledger (operator 6).

Every text version is a blob named by the SHA-256 of its content.  The ledger
holds one row per (blob, rule, rule version) that was scanned, with the spans
found.  A scan takes the distinct blobs of a table, leaves out the pairs that
the ledger already has, runs the rules on the rest and joins all findings back
to every path that holds the blob.  Everything is DataFrame expressions:
``split`` and ``regexp_extract_all`` with the same pattern give the texts
between and inside the matches, whose running lengths are the positions.

Copies are reduced before the shuffle by a partial aggregate.  Only blobs with
findings take part in the join back, which is salted so that a blob held by a
large share of all paths does not meet in one task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut, exists, packed, shared_folder, unpacked


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` is the shortest accepted length of ``group``.
    ``hint`` is a cheaper pattern that every text with a match contains."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str | None = None


# The three base kinds, in their order, then further kinds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, hint=r"[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
    Rule("bearer", r"(?i)\bbearer\x20+([A-Za-z0-9._~+/-]{16,}=*)"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:long,`end`:long>>"


def spans(text: Column, rule: Rule) -> Column:
    """Accepted matches of a rule as (start, end) in code points, end exclusive."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("m"), kept.alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["b"])
        e = a + F.length(p["m"])
        one = F.array(F.struct(a.alias("start"), e.alias("end")))
        return F.struct(e.alias("at"), F.when(F.length(p["g"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint or rule.pattern), found)


def blobs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text): the distinct contents; a null text is the empty content."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))


def scan(contents: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, findings) for contents with unseen pairs.

    findings: array of (kind, version, spans), one entry per rule that ran, so
    a blob without secrets is remembered as scanned too.  ``ledger`` is the
    table of earlier results in the same shape; a blob is skipped for the rules
    whose kind and version it already has.
    """
    if ledger is None:
        todo = contents.withColumn("done", F.expr("cast(array() as array<string>)"))
    else:
        pairs = ledger.select("blob", F.explode("findings").alias("f"))
        done = pairs.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "f.kind", "f.version")).alias("done"))
        todo = contents.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.expr("cast(array() as array<string>)")))
        todo = todo.where(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules]), "done")) > 0)
    entries = [
        F.when(
            ~F.array_contains("done", f"{r.kind}:{r.version}"),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                     F.coalesce(spans(F.col("text"), r), F.expr(f"cast(array() as {SPAN})")).alias("spans")),
        )
        for r in rules
    ]
    return todo.select("blob", F.array_compact(F.array(*entries)).alias("findings"))


SORTED = "array<struct<start:long,rank:int,kind:string,`end`:long>>"


def hits_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs with findings of the given rules and versions;
    found is an array of (start, kind order, kind, end), sorted."""
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    live = F.filter("findings", lambda f: F.array_contains(current, F.concat_ws(":", f["kind"], f["version"])))
    flat = F.flatten(F.transform(live, lambda f: F.transform(f["spans"], lambda s: F.struct(
        s["start"].alias("start"), rank[f["kind"]].alias("rank"), f["kind"].alias("kind"), s["end"].alias("end")))))
    hits = ledger.select("blob", flat.alias("found")).where(F.size("found") > 0)
    return hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def with_findings(docs: DataFrame, hits: DataFrame, text_col: str = "text", salt: int = 32) -> DataFrame:
    """Every row of ``docs`` plus ``found`` (empty array if none); a column of
    that name is replaced."""
    right = hits.select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    left = packed(docs, blob=F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), salt=F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
    found = F.coalesce("found", F.expr(f"cast(array() as {SORTED})"))
    return unpacked(left.join(right, ["blob", "salt"], "left"), [*[c for c in docs.columns if c != "found"], "found"], found=found)


def redact(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, local_rows: int = 300_000, local_spans: int = 1_000_000) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET:kind]``; a span that
    starts inside an earlier one is swallowed by it.  Null texts stay null, all
    other columns stay as they are, whatever their names.

    The blobs with findings are broadcast if they are at most ``local_rows`` with
    ``local_spans`` findings (counted), so that texts need not move; otherwise the
    join is shuffled."""
    hits = cut(hits_by_blob(ledger, rules))
    text = F.col(f"`{text_col}`")
    size = hits.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("spans")).first()
    side = F.broadcast(hits) if size.rows <= local_rows and size.spans <= local_spans else hits
    found = packed(docs, blob=F.sha2(F.coalesce(text, F.lit("")), 256)).join(side, "blob", "left")
    t = F.col(f"row.`{text_col}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        cut_out = F.concat(acc["out"], gap, F.lit("[SECRET:"), s["kind"], F.lit("]"))
        ahead = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, cut_out).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    new = F.when(F.coalesce(F.size("found"), F.lit(0)) > 0, clean).otherwise(t)
    return unpacked(found, docs.columns, **{text_col: new})


LEDGER = f"blob string, findings array<struct<kind:string,version:int,spans:{SPAN}>>"


def extend_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan the pairs of blob and rule version that the ledger table at ``path``
    lacks, append them to it and return the whole ledger.  A missing table is an
    empty ledger; a scan without unseen pairs appends no row."""
    spark = docs.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None
    scan(blobs(docs, text_col), rules, ledger).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def op6_secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans.

    The ledger table (at ``path``, by default in the session's shared folder) is
    extended twice, as two commits of a history would: by every second row with
    the base rules, then by all rows with all rules.  The second scan runs only
    pairs of blob and rule version that the first has not left in the ledger."""
    docs = docs.select("doc_id", "text")
    path = path or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    extend_ledger(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), path, BASE_RULES)
    whole = extend_ledger(docs, path, RULES)
    got = with_findings(docs, hits_by_blob(whole))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    return got.select(
        "doc_id",
        *[n(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", label), ",").alias("spans"),
    )
