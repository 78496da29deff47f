"""Model replies as a table: extraction, validation, merging, request texts.

Nothing is sent anywhere: requests are a column, replies arrive as rows
(job_id, task, attempt, text).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators.redact import sanitise
from millrace.runtime import ship


def clean_reply(c: Column) -> Column:
    """Without reasoning blocks (closed or not) and code fences."""
    t = F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    t = F.regexp_replace(t, r"(?is)<think(?:ing)?>.*$", "")
    return F.regexp_replace(F.regexp_replace(t, "```[A-Za-z]*", ""), r"^\s+|\s+$", "")


def first_object(text: str | None) -> tuple[str | None, str | None]:
    """First balanced {...} of a text, or none / unbalanced."""
    start = (text or "").find("{")
    if start < 0:
        return None, "none"
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return text[start : i + 1], None
    return None, "unbalanced"


def extract_json(replies: DataFrame, text: str = "text") -> DataFrame:
    """``replies`` plus json and failure (none, unbalanced, invalid).  The scan
    for balanced braces has no native form; it runs on Arrow batches."""
    ship(replies.sparkSession)

    @F.pandas_udf("struct<json:string,failure:string>")
    def scan(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_object(x) for x in s], columns=["json", "failure"])

    out = replies.withColumn("_x", scan(clean_reply(F.coalesce(F.col(text), F.lit("")))))
    bad = F.col("_x.json").isNotNull() & F.try_parse_json("_x.json").isNull()
    return out.withColumns({"json": F.when(~bad, F.col("_x.json")), "failure": F.when(bad, "invalid").otherwise(F.col("_x.failure"))}).drop("_x")


DETAILS = "struct<version:int,unscored:boolean,skillsFit:double,seniorityFit:double,location:int,salary:int,company:int,matchedSkills:array<string>,missingSkills:array<string>,failure:string,failedAttempts:int,unscoredFinal:boolean,notes:array<string>>"


def read_details(c: Column) -> Column:
    """Score details of a row; defaults for old rows, null if unreadable."""
    d = F.from_json(c, DETAILS)
    ok = d.isNotNull() & d["unscored"].isNotNull() & (d["unscored"] | d["skillsFit"].isNotNull())
    full = d.withField("failedAttempts", F.coalesce(d["failedAttempts"], F.lit(0))).withField("unscoredFinal", F.coalesce(d["unscoredFinal"], F.lit(False)))
    return F.when(ok, full.withField("notes", F.coalesce(d["notes"], F.array().cast("array<string>"))))


def write_details(c: Column) -> Column:
    return F.to_json(c)


def missing_skills(c: Column) -> Column:
    """Missing skills of a scored row, else an empty list."""
    d = read_details(c)
    return F.when(d["unscored"], F.array().cast("array<string>")).otherwise(F.coalesce(d["missingSkills"], F.array().cast("array<string>")))


def neutral(c: Column) -> Column:
    """A field that cannot act as markup or placeholder."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "[<>{}]", " "))


# What a request says of a posting that is only an excerpt, and of an unknown salary.
SNIPPET_RULE = (
    "- The job text below is only a short excerpt, not the full posting. missingSkills must contain only skills"
    " that are explicitly named in the excerpt; if the excerpt names none, use an empty list."
    " The reason must not speculate about requirements that are not in the text."
)
NOT_STATED = "not stated"


def salary_text(known: Column, estimated: Column, currency: Column, low: Column, high: Column) -> Column:
    """A stated salary as one line; estimated and unknown ones are not stated."""
    amount = lambda c: F.coalesce(F.floor(c + 0.5).cast("long").cast("string"), F.lit("?"))
    text = F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), amount(low), F.lit(" to "), amount(high)))
    return F.when(F.coalesce(known, F.lit(False)) & ~F.coalesce(estimated, F.lit(False)), text).otherwise(F.lit(NOT_STATED))


def posting_fields(rows: DataFrame, limit: int = 8000, values: DataFrame | None = None, texts: tuple[str, ...] = ("title", "company", "location", "description")) -> DataFrame:
    """``rows`` of postings with what requests show of them: texts in ``texts``
    sanitised and unable to act as markup or placeholders, the salary as a line, the
    rule for excerpts, and whether one of the texts tries to give instructions."""
    out = rows
    for name in texts:
        out = sanitise(out, name, limit, values).withColumns({name: neutral(F.col("sanitised")), f"_{name}": F.col("injection_suspected")}).drop("sanitised", "injection_suspected")
    out = out.withColumns({
        "salary": neutral(salary_text(*[F.col(c) for c in ("salary_known", "salary_is_estimated", "currency", "salary_min", "salary_max")])),
        "snippetRule": F.when(F.coalesce("description_is_snippet", F.lit(False)), SNIPPET_RULE).otherwise(F.lit("")),
        "injection_suspected": F.greatest(*[F.col(f"_{name}") for name in texts])})
    return out.drop(*[f"_{name}" for name in texts])


def render(template: str, fields: dict[str, Column]) -> tuple[Column, list[str]]:
    """(text, problems): placeholders {{name}} replaced; unused fields and
    unknown placeholders are listed."""
    import re

    wanted = set(re.findall(r"\{\{(\w+)\}\}", template))
    problems = [f"unknown placeholder: {x}" for x in sorted(wanted - set(fields))] + [f"unused field: {x}" for x in sorted(set(fields) - wanted)]
    out = F.lit(template)
    for name in sorted(wanted & set(fields)):
        out = F.replace(out, F.lit("{{" + name + "}}"), neutral(fields[name]))
    return out, problems


def refresh_plan(ranked: DataFrame, outputs: DataFrame, parts: list[str], version: str, mode: str) -> DataFrame:
    """(job_id, part, action): keep or redo by mode (missing, outdated, force);
    sent jobs are skipped."""
    rows = ranked.select("job_id", "sent", F.explode(F.array(*[F.lit(p) for p in parts])).alias("part")).join(outputs.select("job_id", "part", "value", F.col("version").alias("stored")), ["job_id", "part"], "left")
    old = F.col("value").isNull() | (F.coalesce("stored", F.lit("")) != version)
    redo = {"missing": F.col("value").isNull(), "outdated": old, "force": F.lit(True)}[mode]
    return rows.select("job_id", "part", F.when(F.col("sent"), "skip").when(redo, "redo").otherwise("keep").alias("action"))


def merge_outputs(outputs: DataFrame, redone: DataFrame) -> DataFrame:
    """A failed redo (null value) keeps the old value."""
    new = redone.where("value is not null").select("job_id", "part", F.col("value").alias("_v"), F.col("version").alias("_n"))
    joined = outputs.join(new, ["job_id", "part"], "full_outer")
    return joined.select("job_id", "part", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(F.col("version")).alias("version"))


def approvals(docs: DataFrame, before: DataFrame, content: str = "text") -> DataFrame:
    """(doc_id, content_hash, approved): an approval stays while the content
    hash is the same."""
    now = docs.select("doc_id", F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"))
    return now.join(before.select("doc_id", F.col("content_hash").alias("_h"), "approved"), "doc_id", "left").select(
        "doc_id", "content_hash", F.coalesce(F.col("approved") & (F.col("_h") == F.col("content_hash")), F.lit(False)).alias("approved"))
