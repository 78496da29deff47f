"""Text expressions: Column in, Column out, all JVM-side.

A phrase is bounded when its neighbours are not ASCII letters or digits.  White
space is Unicode white space.  Patterns are built once on the driver from rule
lists, so the JVM compiles one constant regex per rule list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_BEFORE, EDGE_AFTER = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
# Abbreviations that are matched with their case, on the raw text.
ABBREVIATIONS = ("US", "USA", "UK", "EU", "UAE")


def quote(literal: str) -> str:
    """A literal as a Java regex."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&#~])", r"\\\1", literal)


def squeeze(c: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column) -> Column:
    """Lower case, runs of - _ / become a space, white space collapsed."""
    return squeeze(F.regexp_replace(F.lower(c), "[-_/]+", " "))


def normalise_py(s: str) -> str:
    """``normalise`` of a rule literal on the driver."""
    return " ".join(re.sub("[-_/]+", " ", s.lower()).split())


def normalise_company(c: Column) -> Column:
    """``normalise``, then ASCII letters, digits and spaces only."""
    return squeeze(F.regexp_replace(normalise(c), "[^a-z0-9 ]+", ""))


def normalise_company_py(s: str) -> str:
    return " ".join(re.sub("[^a-z0-9 ]+", "", normalise_py(s)).split())


def phrases_pattern(phrases: Iterable[str]) -> str | None:
    """One bounded alternation for a list of phrases; None if all are empty."""
    cores = [quote(p) for p in dict.fromkeys(normalise_py(x) for x in phrases) if p]
    return f"{EDGE_BEFORE}(?:{'|'.join(cores)}){EDGE_AFTER}" if cores else None


def contains_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether the normalised text holds one of the phrases, bounded."""
    pattern = phrases_pattern(phrases)
    return F.coalesce(normalise(c).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def contains_abbreviation(c: Column, term: str) -> Column:
    """Case-sensitive bounded containment in the raw text."""
    return F.coalesce(c.rlike(EDGE_BEFORE + quote(term) + EDGE_AFTER), F.lit(False))


def contains_term(c: Column, term: str) -> Column:
    """Abbreviations with their case, everything else normalised."""
    return contains_abbreviation(c, term) if term in ABBREVIATIONS else contains_any(c, [term])


def remove_phrases(c: Column, phrases: Iterable[str]) -> Column:
    """Remove bounded phrases one after another, longest (as written) first;
    white space is collapsed after each."""
    ordered = sorted(phrases, key=len, reverse=True)
    steps = [p for p in map(normalise_py, ordered) if p]
    return reduce(lambda acc, p: squeeze(F.regexp_replace(acc, EDGE_BEFORE + quote(p) + EDGE_AFTER, " ")), steps, normalise(c))


def contains_centre_token(c: Column) -> Column:
    """The token "gcc", but not in "gcc countries" or "gcc region"."""
    return F.coalesce(normalise(c).rlike(f"{EDGE_BEFORE}gcc{EDGE_AFTER}(?! countries| region)"), F.lit(False))


def fold_aliases(c: Column, aliases: dict[str, str]) -> Column:
    """Normalise a place name and fold aliases ("bengaluru" -> "bangalore")."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), aliases.items(), normalise(c))


def primary_segment(title: Column) -> Column:
    """Up to the first of , : | ( or a spaced hyphen, en dash or em dash."""
    return F.trim(F.regexp_extract(title, r"(?s)^(.*?)(?:[,:|(]| [-–—] |$)", 1))


def role_phrase(role: str) -> str:
    """A role without the tokens "senior" and "sr"."""
    return " ".join(t for t in normalise_py(role).split(" ") if t not in ("senior", "sr"))


def dedupe_part(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{P}+", ""))


def dedupe_key(company: Column, title: Column, location: Column) -> Column:
    """company|title|location without punctuation and case."""
    return F.concat_ws("|", dedupe_part(company), dedupe_part(title), dedupe_part(location))


def html_to_text(c: Column, limit: int | None = 20_000) -> Column:
    """Plain text of HTML: entities are decoded in up to two passes (&amp; last
    in each), script, style and comments dropped, tags removed without leaving a
    space, white space collapsed, cut at ``limit`` code points."""
    text = _decode(_decode(c))
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = squeeze(F.regexp_replace(text, r"(?s)</?[A-Za-z!][^>]*>", ""))
    return F.substring(text, 1, limit) if limit else text


def _decode(c: Column) -> Column:
    """One pass over numeric and six named entities."""
    pieces = F.split(c, r"(?i)&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});", -1)
    codes = F.regexp_extract_all(c, F.lit(r"(?i)&#([0-9]{1,7}|x[0-9a-f]{1,6});"), F.lit(1))
    code = lambda x: F.when(F.lower(x).startswith("x"), F.conv(F.substring(x, 2, 6), 16, 10)).otherwise(x).cast("int")
    letter = lambda n: F.when(n.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")
    joined = F.array_join(F.zip_with(pieces, F.transform(codes, lambda x: letter(code(x))), lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
    numeric = F.when(F.size(codes) > 0, joined).otherwise(c)
    for name, value in (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        numeric = F.regexp_replace(numeric, f"(?i){name}", value)
    return numeric


# Shapes of secrets in log text, replaced in this order.
SECRET_SHAPES = (
    (r"(?i)([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@"),
    (r"(?i)([?&](?:app_id|app_key|api[_-]?key|access_token|token|secret|password|auth|signature|key)=)[^&#\s]*", "$1[redacted]"),
    (r"(?i)\b((?:app_id|app_key|api[_-]?key|access_token|token|secret|password|auth|signature)\s*[:=]\s*)([^\s&]+)", "$1[redacted]"),
    (r"(?i)\bBearer\s+\S+", "Bearer [redacted]"),
    (r"(?i)\bAuthorization\s*:\s*\S+", "Authorization: [redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[redacted]"),
    (r"(?i)\bnvapi-[A-Za-z0-9_-]+\b", "[redacted]"),
)


def scrub_secrets(c: Column) -> Column:
    """Secrets in log text, shape by shape: user information in URLs of any
    scheme, secret query parameters, assignments, bearer tokens, authorization
    headers, two kinds of vendor keys."""
    return reduce(lambda acc, shape: F.regexp_replace(acc, *shape), SECRET_SHAPES, c)


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


# The shape of a number.
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?(?:\s?[kKmM]\b)?"


def number_value(x: Column) -> Column:
    """Normal form of a number literal, to three decimals: 50K and 50,000 are 50000."""
    t = F.lower(F.regexp_replace(x, r"\s", ""))
    factor = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).otherwise(1.0)
    return F.round(F.regexp_replace(t, "[km,]", "").cast("double") * factor, 3)


def numbers(c: Column) -> Column:
    """array<double>: the numbers of a text in order.  A comma only groups three
    digits; a percent sign or a unit is no part of a number."""
    return F.transform(F.regexp_extract_all(c, F.lit(ascii_edges(NUMBER)), F.lit(0)), number_value)


def ascii_edges(pattern: str) -> str:
    """A pattern whose word edges are those of ASCII letters, digits and _."""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def normalise_excerpt(c: Column) -> Column:
    return squeeze(F.lower(c))


def contains_excerpt(text: Column, excerpt: Column) -> Column:
    """Case-insensitive containment with collapsed white space; an empty
    excerpt is contained nowhere."""
    e = normalise_excerpt(excerpt)
    return F.coalesce((F.length(e) > 0) & F.contains(normalise_excerpt(text), e), F.lit(False))


def trim_words(c: Column, limit: int) -> Column:
    """Cut at a word boundary so that the result with an ellipsis fits."""
    t = squeeze(c)
    cut = F.substring(t, 1, limit - 1)
    whole = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.when(F.length(whole) > 0, whole).otherwise(cut), F.lit("…")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
