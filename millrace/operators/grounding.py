"""Claims in a text against a source text, letter rules, sections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.redact import leaks

# Number words and their values, scales, and the nouns before which a lone "one" is a claim.
UNITS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
COUNTED = (
    "year", "years", "month", "months", "week", "weeks", "day", "days", "person", "people", "member", "members", "engineer", "engineers", "user", "users", "team", "teams", "percent")
# Phrases of our own prompts and data that no reader may see.
LABELS = r"(?i)\b(?:must-have|nice-to-have|skills\s+matrix|basedOn|prompt|the\s+profile|candidate\s+profile)\b"
# How a letter begins, and what stands for the writer's name.
SALUTATION, NAME = "Dear Hiring Team,", "{{NAME}}"
# Headings of the known sections.
HEADINGS = {
    "summary": r"(?i)^(?:professional\s+summary|summary|profile|objective|about(?:\s+me)?)$",
    "skills": r"(?i)^(?:technical\s+skills|core\s+skills|skills|technologies|competencies)$",
    "experience": r"(?i)^(?:professional\s+experience|work\s+experience|work\s+history|experience|employment)$",
    "education": r"(?i)^(?:education|academic\s+background|academics)$",
    "projects": r"(?i)^(?:personal\s+projects|key\s+projects|projects)$",
    "certifications": r"(?i)^(?:certifications|certificates|licenses|licences)$",
}


def ungrounded_numbers(claims: Column, source: Column) -> Column:
    """Numbers of a text that the source lacks, repeats kept."""
    have = X.numbers(source)
    return F.filter(X.numbers(claims), lambda n: ~F.array_contains(have, n))


def number_words(c: Column, claims: bool = True) -> Column:
    """array<bigint>: values of the numbers written as words, in order.

    Number words with only white space or hyphens between them are one number.
    With ``claims`` a lone "one" counts only before a counted noun; without
    (the side of the source) everywhere."""
    word = "(?:" + "|".join([*UNITS, *SCALES]) + ")"
    run = rf"(?<![a-z])({word}(?:[\s-]+{word})*)(?![a-z])(?=[^a-z]*([a-z]*))"
    text = F.lower(F.coalesce(c, F.lit("")))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(run), F.lit(1)).alias("run"), F.regexp_extract_all(text, F.lit(run), F.lit(2)).alias("after"))
    if claims:
        found = F.filter(found, lambda x: (x["run"] != "one") | x["after"].isin(*COUNTED))
    value = F.create_map(*[x for k, v in {**UNITS, **SCALES}.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    zero = F.lit(0).cast("long")

    def step(a: Column, w: Column) -> Column:
        v, now = F.try_element_at(value, w), F.when(a["now"] == 0, F.lit(1).cast("long")).otherwise(a["now"])
        unit, hundred = ~w.isin(*SCALES), w == "hundred"
        return F.struct(
            F.when(unit | hundred, a["total"]).otherwise(a["total"] + now * v).alias("total"),
            F.when(unit, a["now"] + v).when(hundred, now * v).otherwise(zero).alias("now"))

    of_run = lambda x: F.aggregate(F.split(x["run"], r"[\s-]+"), F.struct(zero.alias("total"), zero.alias("now")), step, lambda a: a["total"] + a["now"])
    return F.when(text.rlike(run), F.transform(found, of_run)).otherwise(F.expr("cast(array() as array<bigint>)"))


def domain_pattern(term: str) -> str:
    """A term as a whole word; a space or hyphen inside it matches either."""
    return r"(?i)(?<![A-Za-z0-9])" + r"[\s-]+".join(X.quote(w) for w in re.split(r"[\s-]+", term.strip())) + r"(?![A-Za-z0-9])"


def ungrounded_words(claims: Column, source: Column) -> Column:
    """Whether a text has a number word that the source has neither as a word
    nor in digits."""
    have = F.array_union(number_words(source, claims=False).cast("array<double>"), X.numbers(source))
    return F.size(F.array_except(number_words(claims).cast("array<double>"), have)) > 0


def ungrounded_domain(claims: Column, source: Column, terms: list[str], company: Column | None = None) -> Column:
    """Whether a text names a domain that the source lacks; the company's name is
    taken out first."""
    text = F.when(F.trim(company) != "", F.replace(claims, company, F.lit(" "))).otherwise(claims) if company is not None else claims
    tests = [text.rlike(domain_pattern(t)) & ~F.coalesce(source, F.lit("")).rlike(domain_pattern(t)) for t in terms]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def ungrounded_technology(claims: Column, source: Column, technologies: list[str], missing: Column | None = None) -> Column:
    """Whether a text names a technology, or one of the array ``missing``, that
    the source lacks."""
    has = lambda c, t: F.coalesce(c, F.lit("")).rlike(t)
    tests = [has(claims, p) & ~has(source, p) for p in (technology_pattern(t) for t in technologies)]
    if missing is not None:
        edge = lambda m: F.concat(F.lit(r"(?i)(?<![0-9A-Za-z])\Q"), m, F.lit(r"\E(?![0-9A-Za-z+#])"))
        tests.append(F.coalesce(F.exists(missing, lambda m: F.regexp_like(claims, edge(m)) & ~F.regexp_like(F.coalesce(source, F.lit("")), edge(m))), F.lit(False)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def technology_pattern(name: str) -> str:
    """A technology as a whole word; short names and those written with = keep
    their case."""
    bare = name.removeprefix("=").strip()
    cased = name.startswith("=") or len(bare) <= 2
    return ("" if cased else "(?i)") + "(?<![0-9A-Za-z])" + r"[\s-]+".join(X.quote(w) for w in re.split(r"[\s-]+", bare)) + "(?![0-9A-Za-z+#])"


def claim_codes(claims: Column, source: Column, domain_terms: list[str], company: Column | None = None, technologies: list[str] | None = None, missing: Column | None = None) -> Column:
    """array of ungrounded_technology, ungrounded_number, ungrounded_domain,
    internal_label, for a short text."""
    tests = (
        (ungrounded_technology(claims, source, technologies or [], missing), "ungrounded_technology"), (ungrounded_words(claims, source), "ungrounded_number"),
        (ungrounded_domain(claims, source, domain_terms, company), "ungrounded_domain"), (claims.rlike(LABELS), "internal_label"))
    return F.array_compact(F.array(*[F.when(t, c) for t, c in tests]))


def letter_codes(
    c: Column, source: Column | None = None, domain_terms: list[str] | None = None, technologies: list[str] | None = None, missing: Column | None = None, company: Column | None = None,
    max_words: int = 200,
) -> Column:
    """Problem codes of a letter in a fixed order; an empty letter has only that
    one.  Technologies are checked from the second paragraph on, since the first
    may repeat what the posting asks for."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    source = F.coalesce(source, F.lit("")) if source is not None else F.lit("")
    name = X.quote(NAME)
    others = F.replace(t, F.lit(NAME), F.lit(""))
    phone = F.exists(F.regexp_extract_all(t, F.lit(r"\+?\d[\d\s().-]{7,}\d"), F.lit(0)), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 9)
    body = F.slice(paragraphs(t), F.lit(2), F.greatest(F.size(paragraphs(t)) - 1, F.lit(0)))
    technology = F.exists(body, lambda p: ungrounded_technology(p, source, technologies or [], missing)) if technologies or missing is not None else F.lit(False)
    tests = (
        (X.word_count(t) > max_words, "too_long"), (~t.startswith(SALUTATION), "salutation"), (F.size(F.split(t, name, -1)) != 2, "name_placeholder_count"),
        (~t.endswith(NAME), "sign_off"), (others.rlike(r"[{}]|\[[^\]]*\]"), "other_placeholder"), (t.rlike(r"(?i)https?://|www\.|\b[a-z0-9-]+\.(com|org|io)\b"), "url"),
        (t.rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+"), "email"), (phone, "phone"), (t.rlike(r"(?m)```|\*\*|__|^\s{0,3}#{1,6}\s|^\s*[-*•]\s"), "markdown"), (F.size(leaks(t)) > 0, "pii"),
        ((F.size(ungrounded_numbers(t, source)) > 0) | ungrounded_words(t, source), "ungrounded_number"), (technology, "ungrounded_technology"),
        (ungrounded_domain(t, source, domain_terms or [], company), "ungrounded_domain"), (t.rlike(LABELS), "internal_label"))
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(x, code) for x, code in tests])))


def paragraphs(c: Column) -> Column:
    """Paragraphs without salutation and sign-off."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.filter(parts, lambda p: ~p.rlike(r"(?i)^(?:dear|hello|hi)\b[^\n]{0,60}$") & ~p.rlike(r"(?i)^(?:kind |best |warm )?(?:regards|sincerely|thanks)\b"))


# Bounds of a list of suggestions and of their texts; what is no plain text.
LEAST_ITEMS, MOST_ITEMS, ITEM_WORDS, BASIS_WORDS, SECTION_LENGTH = 3, 5, 25, 12, 60
NOT_PLAIN = r"(?i)https?://|www\.|@|[{}]"


def suggestion_errors(item: Column) -> Column:
    """What is wrong with a suggestion (section, suggestion, reason, basedOn)."""
    def of(name: str, words: int | None = None, length: int | None = None) -> list[Column]:
        t = F.regexp_replace(item[name], r"(?U)^\s+|\s+$", "")
        bad = F.when(F.coalesce(t, F.lit("")) == "", f"{name} is empty")
        bad = bad.when(X.word_count(t) > words, f"{name} is too long") if words else bad.when(F.length(t) > length, f"{name} is too long")
        return [bad, F.when(t.rlike(NOT_PLAIN), f"{name} is no plain text")]

    return F.array_compact(F.array(*of("section", length=SECTION_LENGTH), *of("suggestion", ITEM_WORDS), *of("reason", ITEM_WORDS), *of("basedOn", BASIS_WORDS)))


def kept_suggestions(rows: DataFrame, items: str, source: str, domain_terms: list[str], technologies: list[str] | None = None) -> DataFrame:
    """``rows`` plus errors, kept and valid.

    A list of another length than 3 to 5, or with a wrong item, is refused whole.
    Of the others items stay whose suggestion and reason claim nothing that the
    source lacks, and whose basis stands in the source; at least 3 must."""
    def grounded(x: Column) -> Column:
        claims = F.concat_ws(" ", x["suggestion"], x["reason"])
        return (F.size(claim_codes(claims, F.col(source), domain_terms, technologies=technologies)) == 0) & X.contains_excerpt(F.col(source), x["basedOn"])

    each = F.flatten(F.transform(items, lambda x, i: F.transform(suggestion_errors(x), lambda e: F.concat(F.lit("["), i.cast("string"), F.lit("] "), e))))
    number = F.when(F.coalesce(F.size(items), F.lit(0)).between(LEAST_ITEMS, MOST_ITEMS), F.array().cast("array<string>")).otherwise(F.array(F.lit("wrong number of items")))
    out = rows.withColumn("errors", F.concat(number, F.coalesce(each, F.array().cast("array<string>"))))
    out = out.withColumn("kept", F.when(F.size("errors") == 0, F.filter(items, grounded)).otherwise(F.slice(items, 1, 0)))
    return out.withColumn("valid", F.coalesce(F.size("kept") >= LEAST_ITEMS, F.lit(False)))


def grounding_text(profile: Column, strengths: Column) -> Column:
    """What claims are held against: the profile and the listed strengths."""
    return F.concat_ws("\n", profile, F.array_join(strengths, ", "))


def heading_section(line: Column) -> Column:
    """Section that a heading line opens, or null: a known heading, or "other"
    for a short line of capitals without a full stop."""
    bare = F.trim(F.regexp_replace(F.trim(line), ":$", ""))
    unknown = (F.length(bare) <= 40) & ~bare.rlike("[.a-z]") & bare.rlike("[A-Z]")
    out = F.when(unknown, "other")
    for name, pattern in HEADINGS.items():
        out = F.when(bare.rlike(pattern), name).otherwise(out)
    return out


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, text) of each row: lines under each section, joined in
    order and trimmed; lines before any heading belong to "other".  Sections
    without text have no row.

    Each row's lines are cut at its headings and put together again inside the
    row: nothing is shuffled, and rows that repeat an id stay apart."""
    lines = docs.select(id_col, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    heads = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), heading_section(x).alias("section")))
    first = F.struct(F.lit(-1).alias("at"), F.lit("other").alias("section"))
    marked = lines.withColumn("_heads", F.concat(F.array(first), F.filter(heads, lambda h: h["section"].isNotNull())))
    end = lambda i: F.coalesce(F.try_element_at(F.col("_heads"), i + 2)["at"], F.size("_lines"))
    parts = F.transform("_heads", lambda h, i: F.struct(h["section"].alias("section"), F.slice("_lines", h["at"] + 2, end(i) - h["at"] - 1).alias("lines")))
    marked = marked.select(id_col, parts.alias("_parts"))
    under = lambda name: F.array_join(F.flatten(F.transform(F.filter("_parts", lambda p: p["section"] == name), lambda p: p["lines"])), "\n")
    names = F.array_distinct(F.transform("_parts", lambda p: p["section"]))
    out = F.transform(names, lambda n: F.struct(n.alias("section"), F.regexp_replace(under(n), r"(?U)^\s+|\s+$", "").alias("text")))
    return marked.select(id_col, F.inline(out)).where("text <> ''")


def format_profile(parts: dict[str, Column]) -> Column:
    """"## Heading" blocks; an empty section reads (none)."""
    blocks = [F.concat(F.lit(f"## {name}\n"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(none)"))) for name, c in parts.items()]
    return F.concat_ws("\n\n", *blocks)
