"""Personal data: detection, redaction, leak gates.

Shapes (emails, URLs, phone numbers) are found by native expressions, shape by
shape.  Listed values (persons, addresses, emails, phones, others) are a table;
all of them are looked for in one pass over a text, and their spans are resolved
together with those of the shapes: the earliest start wins, then the longest, then
the order in which kinds are collected; overlaps are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_edges, html_to_text, quote, squeeze
from millrace.operators import automaton

# The shapes of emails and URLs, and what is trimmed at the end of a URL.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_SHAPES = (
    r"\bhttps?://[^\s<>\])\"'`]+",
    r"\bwww\.[^\s<>\])\"'`]+",
    r"\blinkedin\.com/in/[A-Za-z0-9._%-]+/?",
    r"\bgithub\.com/[A-Za-z0-9._-]+/?",
)
URL_END = r"[.,);:\"']+$"

# The shapes of phone numbers.
PHONE_SHAPES = (
    r"\+\d{1,3}(?:[\s().-]*\d){10,14}",
    r"\(\d{3}\)\s*\d{3}[-.\s]\d{4}",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\b0\d{4,5}[-.\s]\d{5}\b",
    r"\b[6-9]\d{4}[-.\s]\d{5}\b",
    r"\b0[6-9]\d{9}\b",
    r"\b[6-9]\d{9}\b",
)

# What tells other numbers from phone numbers.
METRIC = r"^\s*(users|user|requests|req|ms|seconds|secs|minutes|hours|gb|mb|kb|tb|rows|records|customers|employees|downloads|lines|commits|qps|rps|tps)\b"
AMOUNT = r"(?:\$|₹|€|£|usd|inr|rs\.?)\s*$"
DATE_SHAPES = (r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$")
YEAR = r"\b(19|20)\d{2}\b"
VERSION = r"^\d+(?:\.\d+){1,}$"

# Words and places of address lines, and what may stand beside placeholders.
ADDRESS_WORD = r"\b(Road|Street|Nagar|Layout|Apartment)\b"
PLACES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
    "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
    "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "andaman and nicobar",
    "jammu and kashmir", "delhi", "chandigarh", "puducherry", "ladakh", "mumbai", "bengaluru", "bangalore", "hyderabad", "ahmedabad",
    "chennai", "kolkata", "pune", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "bhopal", "patna", "vadodara", "ludhiana", "agra",
    "nashik", "varanasi", "srinagar", "ranchi", "coimbatore", "jodhpur", "madurai", "raipur", "guwahati", "mysuru", "mysore", "gurugram",
    "gurgaon", "noida",
)
PLACEHOLDER = r"\[(NAME|EMAIL|PHONE|URL|ADDRESS)\]"
SEPARATORS = r"[\s|,./:;·•\-*–—_]+"

# Phrases that try to give instructions.
INJECTION = ("ignore previous instructions", "system prompt", "you are now")

KINDS = ("name", "email", "phone", "url", "address")
SPAN = "array<struct<start:int,`end`:int,kind:string,place:int>>"
STORED_EMAIL, SHAPED_EMAIL, SHAPED_URL, STORED_PHONE, SHORT_PHONE, SHAPED_PHONE, STORED_ADDRESS, STORED_NAME, OTHER = range(9)
_NONE = f"cast(array() as {SPAN})"


def pattern_spans(c: Column, pattern: str, kind: str, place: int, end: str | None = None) -> Column:
    """Spans of a pattern in code points, without what ``end`` matches at their ends."""
    pattern = ascii_edges(pattern)
    between, hit = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(between, 1, F.size(hit)).alias("b"), hit.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["b"])
        kept = F.regexp_replace(p["m"], end, "") if end else p["m"]
        one = F.struct(a.alias("start"), (a + F.length(kept)).alias("end"), F.lit(kind).alias("kind"), F.lit(place).alias("place"))
        return F.struct((a + F.length(p["m"])).alias("at"), F.array_append(acc["out"], one).alias("out"))

    return F.when(c.rlike(pattern), F.filter(F.aggregate(parts, start, step, lambda a: a["out"]), lambda s: s["end"] > s["start"])).otherwise(F.expr(_NONE))


def is_phone(c: Column, s: Column) -> Column:
    """10 to 15 digits that touch no other digit, have no unit of measure behind
    and no sign of money before them, and are neither a date nor a version."""
    m = F.trim(F.substring(c, s["start"] + 1, s["end"] - s["start"]))
    head = F.substring(c, F.greatest(s["start"] - 7, F.lit(1)), F.least(s["start"], F.lit(8)))
    tail = F.substring(c, s["end"] + 1, F.length(c))
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    date = m.rlike("|".join(DATE_SHAPES)) | (m.rlike(ascii_edges(YEAR)) & m.rlike("[/-]"))
    loose = ~head.rlike("[0-9]$") & ~tail.rlike("^[0-9]")
    return digits.between(10, 15) & loose & ~tail.rlike("(?i)" + ascii_edges(METRIC)) & ~head.rlike("(?i)" + AMOUNT) & ~date & ~m.rlike(VERSION)


def spans(c: Column) -> Column:
    """All spans of emails, URLs and phone numbers by their shapes, unresolved."""
    found = [pattern_spans(c, EMAIL, "email", SHAPED_EMAIL)]
    found += [pattern_spans(c, "(?i)" + p, "url", SHAPED_URL, URL_END) for p in URL_SHAPES]
    phones = F.concat(*[pattern_spans(c, p, "phone", SHAPED_PHONE) for p in PHONE_SHAPES])
    phones = F.when(c.rlike("[0-9]{4}"), F.filter(phones, lambda s: is_phone(c, s))).otherwise(F.expr(_NONE))
    return F.concat(*found, phones)


def resolve(found: Column) -> Column:
    """Sorted by start, longest first; a span that begins inside a kept one goes."""
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("shortness"), s["place"].alias("place"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), (-s["shortness"]).alias("end"), s["kind"].alias("kind"), s["place"].alias("place"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, -s["shortness"]).otherwise(acc["at"]).alias("at"), F.when(free, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(keyed, start, step, lambda a: a["out"])


def apply_spans(c: Column, kept: Column) -> Column:
    """Replace resolved spans by [KIND]."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(c, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
    return F.aggregate(kept, start, step, lambda a: F.concat(a["out"], F.substring(c, a["at"] + 1, F.length(c))))


def listed(values: DataFrame) -> DataFrame:
    """(value, digits, kind, place, size) from values (kind, value).

    Kinds are name, email, phone, address and other.  Parts of names of three or
    more letters stand for themselves too; other values take the kind of their
    shape.  Phones of eight or more digits are looked for by their digits, without
    country codes and leading zeros (``digits``)."""
    v = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = values.select("kind", v.alias("value")).where(F.col("value") != "")
    n = F.length(F.regexp_replace("value", "[^0-9]", ""))
    shape = F.when(F.col("value").rlike(EMAIL), "email").when(F.col("value").rlike(r"(?i)https?://|www\.|linkedin\.com/in/|github\.com/"), "url")
    shape = shape.when(n.between(10, 15), "phone").when(is_address_line(F.col("value")), "address").otherwise("name")
    named = {"name": STORED_NAME, "email": STORED_EMAIL, "phone": STORED_PHONE, "address": STORED_ADDRESS}
    place = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in named.items()], F.lit(OTHER))
    parts = F.filter(F.split("value", " "), lambda x: F.length(x) >= 3)
    texts = F.when(F.col("kind") == "name", F.array_union(F.array("value"), parts)).otherwise(F.array("value"))
    rows = rows.select(F.explode(texts).alias("value"), F.when(F.col("kind") == "other", shape).otherwise(F.col("kind")).alias("shape"), place.alias("place"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    for pattern in (r"^00", r"^91(?=[0-9]{10}$)", r"^0(?=[0-9]{10}$)", r"^1(?=[0-9]{10}$)"):
        digits = F.regexp_replace(digits, pattern, "")
    digits = F.when((F.col("place") == STORED_PHONE) & (F.length(digits) >= 8), digits)
    place = F.when((F.col("place") == STORED_PHONE) & digits.isNull(), SHORT_PHONE).otherwise(F.col("place"))
    return rows.select("value", digits.alias("digits"), F.col("shape").alias("kind"), place.alias("place"), F.length("value").alias("size")).distinct()


_GAP = re.compile(r"\s+")
_WORD = re.compile(r"[0-9A-Za-z_]")
_RUN = re.compile(r"[0-9](?:[\s().-]*[0-9]){7,}")
_LEAD = re.compile(r"(?:\+[0-9]{1,3}[\s().-]*)?(?:0[\s().-]*)?\Z")


def value_finder(rows: list[dict]) -> Callable[[str], list[dict]]:
    """Spans of listed values in a text, in any case and with any white space
    between their words, cut off by word edges; of phones by their digits."""
    literal = [r for r in rows if r["digits"] is None]
    phones = [r for r in rows if r["digits"] is not None]
    words = automaton.build(unique := list(dict.fromkeys(automaton.lowered(r["value"]) for r in literal)))
    same: dict[str, list[dict]] = {}
    for r in literal:
        same.setdefault(automaton.lowered(r["value"]), []).append(r)
    numbers = automaton.build(list(dict.fromkeys(r["digits"] for r in phones)))

    def edge(t: str, i: int) -> bool:
        return bool(i > 0 and _WORD.match(t[i - 1])) != bool(i < len(t) and _WORD.match(t[i]))

    def look(text: str) -> list[dict]:
        flat, out = automaton.Flat(text, _GAP), []
        for start, stop, i in automaton.hits(words, automaton.lowered(flat.text)):
            if edge(flat.text, start) and edge(flat.text, stop):
                a, b = flat.span(start, stop)
                out += [{"start": a, "end": b, "kind": r["kind"], "place": r["place"]} for r in same[unique[i]]]
        for run in _RUN.finditer(text) if phones else ():
            at = [k for k in range(run.start(), run.end()) if "0" <= text[k] <= "9"]
            for start, stop, _ in automaton.hits(numbers, "".join(text[k] for k in at)):
                before = max(0, at[start] - 64)
                a = before + _LEAD.search(text[before : at[start]]).start()
                out.append({"start": a, "end": at[stop - 1] + 1, "kind": "phone", "place": STORED_PHONE})
        return out

    return look


def with_spans(rows: DataFrame, text: str, values: DataFrame | None = None, limit: int = automaton.LIMIT) -> DataFrame:
    """``rows`` plus ``_kept``, the resolved spans of a column."""
    c = F.coalesce(F.col(text), F.lit(""))
    if values is None:
        return rows.withColumn("_kept", resolve(spans(c)))
    both = automaton.with_found(rows, text, listed(values), "size", value_finder, "start int, `end` int, kind string, place int", limit)
    stored = F.filter("_found", lambda s: (s["place"] != STORED_PHONE) | is_phone(c, s))
    return both.withColumn("_kept", resolve(F.concat(stored, spans(c)))).drop("_found")


def redact(rows: DataFrame, text: str = "text", values: DataFrame | None = None, places: tuple[str, ...] = PLACES, limit: int = automaton.LIMIT) -> DataFrame:
    """``rows`` plus redacted, n_name, n_email, n_phone, n_url, n_address.

    ``values`` (kind, value) are listed values.  Then lines of addresses become
    [ADDRESS], and lines that hold only placeholders and separators go."""
    done = with_spans(rows, text, values, limit)
    c = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(apply_spans(c, F.col("_kept")), "\n")
    done = done.withColumn("_lines", F.transform(lines, lambda x: F.struct(x.alias("x"), (is_address_line(x, places) & ~is_placeholders(x)).alias("a"))))
    of_kind = lambda k: F.size(F.filter("_kept", lambda s: s["kind"] == k))
    count = {k: of_kind(k) for k in KINDS}
    count["address"] = count["address"] + F.size(F.filter("_lines", lambda s: s["a"]))
    kept = F.filter(F.transform("_lines", lambda s: F.when(s["a"], F.lit("[ADDRESS]")).otherwise(s["x"])), lambda x: ~is_placeholders(x))
    return done.withColumns({"redacted": F.array_join(kept, "\n"), **{f"n_{k}": n for k, n in count.items()}}).drop("_kept", "_lines")


def is_address_line(x: Column, places: tuple[str, ...] = PLACES) -> Column:
    """A word of addresses, or a six-digit code next to a listed place."""
    listed_ = "|".join(quote(p) for p in places)
    near = rf"\b\d{{6}}\b[\s,.-]{{0,3}}(?:{listed_})\b|\b(?:{listed_})\b[\s,.-]{{0,3}}\d{{6}}\b" if places else None
    return x.rlike("(?i)" + ascii_edges(ADDRESS_WORD)) | (x.rlike("(?i)" + ascii_edges(near)) if near else F.lit(False))


def is_placeholders(x: Column) -> Column:
    return x.rlike(PLACEHOLDER) & (F.regexp_replace(F.regexp_replace(x, PLACEHOLDER, ""), SEPARATORS, "") == "")


def redact_address_lines(c: Column, places: tuple[str, ...] = PLACES) -> Column:
    """Lines of addresses become [ADDRESS]; lines that hold only placeholders go."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(is_address_line(x, places) & ~is_placeholders(x), F.lit("[ADDRESS]")).otherwise(x))
    return F.array_join(F.filter(lines, lambda x: ~is_placeholders(x)), "\n")


def leaks(c: Column) -> Column:
    """Sorted kinds of shapes that are still in a text; empty means clean."""
    return F.array_sort(F.array_distinct(F.transform(spans(F.coalesce(c, F.lit(""))), lambda s: s["kind"])))


def quarantine(rows: DataFrame, text: str = "text", values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows with column leaks: the kinds of data they still hold)."""
    marked = with_spans(rows, text, values)
    marked = marked.withColumn("leaks", F.array_sort(F.array_distinct(F.transform("_kept", lambda s: s["kind"])))).drop("_kept")
    return marked.where(F.size("leaks") == 0).drop("leaks"), marked.where(F.size("leaks") > 0)


def sanitise(rows: DataFrame, text: str = "text", limit: int = 8000, values: DataFrame | None = None) -> DataFrame:
    """``rows`` plus sanitised, the plain text, redacted, collapsed and cut at
    ``limit``, and injection_suspected, whether that tries to give instructions."""
    plain = rows.withColumn("_plain", html_to_text(F.coalesce(F.col(text), F.lit("")), None))
    done = redact(plain, "_plain", values).withColumn("sanitised", F.substring(squeeze(F.col("redacted")), 1, limit))
    low = F.lower("sanitised")
    return done.withColumn("injection_suspected", F.greatest(*[low.contains(p) for p in INJECTION])).drop("_plain", "redacted")
