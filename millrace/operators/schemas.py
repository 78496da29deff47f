"""Reply schemas as data, compiled to one expression.

A schema is a list of fields; ``from_table`` reads one from rows.  The compiled
expression parses a reply once and gives its typed value and the errors, each with
the path it belongs to.  Types are strict; sizes are not: texts are cut at a word
boundary, lists keep their first items.  Keys that no field names are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import trim_words

NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


class Field(NamedTuple):
    """A field of a reply.

    kind: number, string or strings.  least and most bound numbers; ``items`` and
    ``length`` bound lists and texts; ``filled``: blank texts and items are errors
    (else blank items are dropped); ``allowed``: the texts that a string may be.
    """

    path: str
    kind: str
    least: float | None = None
    most: float | None = None
    items: int | None = None
    length: int | None = None
    filled: bool = False
    allowed: tuple[str, ...] | None = None


# What a judgement of a posting may hold.
JUDGEMENT = (
    Field("skillsFit", "number", 0, 100),
    Field("seniorityFit", "number", 0, 100),
    Field("matchedSkills", "strings", items=8, length=80),
    Field("missingSkills", "strings", items=8, length=80),
    Field("redFlags", "strings", items=3, length=120),
    Field("reason", "string", length=200, filled=True),
    Field("roleType", "string", allowed=("backend", "lead", "architect", "other")),
)

# What a skills matrix may hold.
MATRIX = (
    Field("yearsExperience", "number", 0),
    Field("currentLevel", "string", filled=True),
    Field("targetRoles", "strings", filled=True),
    Field("mustHave", "strings", filled=True),
    Field("niceToHave", "strings", filled=True),
    Field("avoid", "strings", filled=True),
    Field("strengths", "strings", filled=True),
)


def from_table(rows: DataFrame) -> list[Field]:
    """Fields from rows with the columns of ``Field`` (as many rows as fields)."""
    return [Field(**{**r.asDict(), "filled": bool(r.filled), "allowed": tuple(r.allowed) if r.allowed else None}) for r in rows.select(*Field._fields).collect()]


def _check(v: Column, f: Field) -> tuple[Column, Column]:
    """(typed value, array of errors) of one field of an object."""
    raw = F.try_variant_get(v, f"$.{f.path}", "variant")
    kind = F.schema_of_variant(raw)
    error = lambda what: F.lit(f"{f.path}: {what}")
    if f.kind == "number":
        x = F.when(kind.rlike(NUMBER), F.try_variant_get(raw, "$", "double"))
        low, high = (x < f.least if f.least is not None else F.lit(False)), (x > f.most if f.most is not None else F.lit(False))
        return x, F.array(F.when(x.isNull(), error("not a number")).when(low | high, error("out of range")))
    if f.kind == "string":
        x = F.when(kind == "STRING", F.try_variant_get(raw, "$", "string"))
        trimmed = F.regexp_replace(x, r"(?U)^\s+|\s+$", "") if f.filled else x
        bad = F.when(x.isNull(), error("not a text"))
        bad = bad.when(trimmed == "", error("empty")) if f.filled else bad
        bad = bad.when(~x.isin(*f.allowed), error("not allowed")) if f.allowed else bad
        return trim_words(trimmed, f.length) if f.length else trimmed, F.array(bad)
    listed = F.try_variant_get(raw, "$", "array<variant>")
    texts = F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.regexp_replace(F.try_variant_get(x, "$", "string"), r"(?U)^\s+|\s+$", "")))
    at = lambda i, what: F.concat(F.lit(f"{f.path}["), i.cast("string"), F.lit(f"]: {what}"))
    blank = (lambda x, i: F.when(x == "", at(i, "empty"))) if f.filled else (lambda x, i: F.lit(None).cast("string"))
    items = F.transform(texts, lambda x, i: F.when(x.isNull(), at(i, "not a text")).otherwise(blank(x, i)))
    kept = F.filter(texts, lambda x: x != "")
    kept = F.slice(kept, 1, f.items) if f.items else kept
    kept = F.transform(kept, lambda x: trim_words(x, f.length)) if f.length else kept
    return kept, F.when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.array(error("not a list"))).otherwise(items)


def validate(replies: DataFrame, fields: list[Field] | tuple[Field, ...], json: str = "json") -> DataFrame:
    """``replies`` plus value (a struct of the fields, null if there is an error),
    errors and valid.  A null, broken or other text than an object has one error."""
    parsed = replies.withColumn("_v", F.try_parse_json(json))
    v = F.col("_v")
    checks = [_check(v, f) for f in fields]
    found = F.array_compact(F.concat(*[e for _, e in checks]))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    out = parsed.withColumn("errors", F.when(is_object, found).otherwise(F.array(F.lit("$: not an object"))))
    out = out.withColumn("valid", F.size("errors") == 0)
    return out.withColumn("value", F.when(F.col("valid"), F.struct(*[x.alias(f.path) for f, (x, _) in zip(fields, checks, strict=True)]))).drop("_v")


def format_matrix(m: Column) -> Column:
    """A skills matrix as lines of text; empty lists read (none), a
    null matrix is null."""
    listed = lambda key: F.coalesce(F.nullif(F.array_join(m[key], ", "), F.lit("")), F.lit("(none)"))
    years = m["yearsExperience"]
    whole = F.when(years == F.floor(years), years.cast("long").cast("string")).otherwise(years.cast("string"))
    lines = [("Years of experience", whole), ("Level", m["currentLevel"]), ("Target roles", listed("targetRoles")), ("Must have", listed("mustHave")), ("Nice to have", listed("niceToHave")), ("Avoid", listed("avoid")), ("Strengths", listed("strengths"))]
    return F.when(m.isNotNull(), F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), c) for name, c in lines]))
