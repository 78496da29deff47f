"""Vocabulary terms in texts.

All aliases are looked for in one pass over a text, by an automaton over lower
case and single spaces.  A hit must not touch letters or digits, nor + or # if it
ends with one of those; aliases with a case are compared with it.  Of overlapping
hits the longest stays, then the first in the vocabulary.  A vocabulary too large
for one broadcast meets the texts on the first word of its aliases instead.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import quote
from millrace.operators import automaton
from millrace.runtime import cut, ship


def read_vocabulary(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """(alias, canonical, case_sensitive, key, n_words, place) from lines "a|b|c":
    blanks and # lines are skipped, the first alias is the canonical name, a
    leading = or a length of at most two makes an alias case-sensitive.  ``place``
    is an alias's place: that of its line (column ``order``, else as read) and in it."""
    text = F.trim(column)
    rows = lines.select(text.alias("_t"), (F.col(order).cast("long") if order else F.monotonically_increasing_id()).alias("_line")).where((F.col("_t") != "") & ~F.col("_t").startswith("#")).select("_line", F.split("_t", r"\|").alias("names"))
    bare = lambda x: F.regexp_replace(F.trim(x), "^=", "")
    named = F.filter(F.transform("names", lambda x: F.trim(x)), lambda x: bare(x) != "")
    out = rows.withColumn("names", named).select(bare(F.try_element_at("names", F.lit(1))).alias("canonical"), "_line", F.posexplode("names").alias("_pos", "raw"))
    out = out.select("canonical", F.struct(F.col("_line").alias("line"), F.col("_pos").alias("pos")).alias("place"), bare(F.col("raw")).alias("alias"), (F.trim("raw").startswith("=") | (F.length(bare(F.col("raw"))) <= 2)).alias("case_sensitive"))
    return out.withColumns({"key": key(F.col("alias")), "n_words": F.size(F.split(key(F.col("alias")), " "))})


def key(c: Column) -> Column:
    """Lower case, space and hyphen interchangeable."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s-]+", " "))


# White space as the vocabulary's patterns know it.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_GAP = re.compile(f"[{SPACE}-]+")
_PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
FIRST_WORD = "[0-9A-Za-z]+"


def matcher(aliases: list[dict]) -> Callable[[str], list[tuple]]:
    """All hits of a text: (start, stop, line, pos, canonical), in code points."""
    keys = [_GAP.sub(" ", a["alias"]) for a in aliases]
    same: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        same.setdefault(automaton.lowered(k), []).append(i)
    groups = list(same.values())
    machine = automaton.build(list(same))

    def look(text: str) -> list[tuple]:
        flat = automaton.Flat(text, _GAP)
        plain, out = flat.text, []
        for start, stop, g in automaton.hits(machine, automaton.lowered(plain)):
            if start and plain[start - 1] in _PLAIN or stop < len(plain) and plain[stop] in _PLAIN:
                continue
            glued = plain[stop - 1] in _PLAIN and stop < len(plain) and plain[stop] in "+#"
            for i in groups[g]:
                a = aliases[i]
                if not glued and (not a["case_sensitive"] or plain[start:stop] == keys[i]):
                    out.append((*flat.span(start, stop), a["line"], a["pos"], a["canonical"]))
        return out

    return look


def longest_first(found: list[tuple]) -> list[str]:
    """Canonical names of the hits that stay, in order of appearance, each once."""
    taken: list[tuple[int, int, str]] = []  # sorted, apart from each other
    for start, stop, _, _, name in sorted(found, key=lambda h: (h[0] - h[1], h[2], h[3], h[0])):
        k = bisect_right(taken, (start, stop, "􏿿"))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= stop):
            taken.insert(k, (start, stop, name))
    return list(dict.fromkeys(name for _, _, name in taken))


def find_terms(texts: DataFrame, vocabulary: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = automaton.LIMIT) -> DataFrame:
    """(id, terms) of every row of ``texts``: canonical names in order of
    appearance, each once; rows without a term have an empty list, and repeated
    ids stay apart.

    A vocabulary of at most ``limit`` characters is broadcast; beyond that texts
    meet the aliases that start with one of their words in an equi-join (aliases
    without letters and digits meet all texts), and each text is searched for
    these alone."""
    ship(texts.sparkSession)
    flat = vocabulary.select("alias", "canonical", "case_sensitive", F.col("place.line").alias("line"), F.col("place.pos").alias("pos"), F.length("alias").alias("size"))
    rows = texts.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if (flat.agg(F.sum("size")).first()[0] or 0) <= limit:
        return automaton.search(rows, flat, "size", lambda part: _terms_of(matcher(part)), "name string", limit).select(id_col, F.transform("found", lambda x: x["name"]).alias("terms"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    word = lambda c: F.lower(F.regexp_extract(c, f"({FIRST_WORD})", 1))
    words = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(f"({FIRST_WORD})"), F.lit(1)), lambda w: F.lower(w)))
    there = rows.select("_row", F.explode(F.array_append(words, F.lit(""))).alias("_w"))
    met = there.join(flat.withColumn("_w", word(F.col("alias"))).hint("merge"), "_w")
    some = met.groupBy("_row").agg(F.collect_list(F.struct("alias", "canonical", "case_sensitive", "line", "pos")).alias("aliases"))
    both = rows.join(some.hint("merge"), "_row", "left").select(id_col, "aliases", "_text")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            terms = [longest_first(matcher(a or [])(t)) for a, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], names=[id_col, "terms"])

    return both.mapInArrow(run, f"`{id_col}` {kind}, terms array<string>")


def _terms_of(look: Callable[[str], list[tuple]]) -> Callable[[str], list[dict]]:
    return lambda text: [{"name": x} for x in longest_first(look(text))]


def canonical_names(names: DataFrame, vocabulary: DataFrame, name: str = "name") -> DataFrame:
    """``names`` plus canonical; unknown names stand for themselves."""
    known = vocabulary.groupBy(F.col("key").alias("_key")).agg(F.min("canonical").alias("canonical"))
    return names.withColumn("_key", key(F.col(name))).join(known, "_key", "left").withColumn("canonical", F.coalesce("canonical", F.col(name))).drop("_key")


def mentioned(rows: DataFrame, vocabulary: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """``rows`` plus mentioned: whether the text names the row's own name, under
    any alias of it if the vocabulary knows it, else as bounded text."""
    known = vocabulary.groupBy(F.col("key").alias("_key")).agg(F.max_by("canonical", "place").alias("_canonical"))
    others = vocabulary.groupBy(F.col("canonical").alias("_canonical")).agg(F.collect_set(F.struct("alias", "case_sensitive")).alias("_aliases"))
    joined = rows.withColumn("_key", key(F.col(name))).join(known, "_key", "left").join(others, "_canonical", "left")
    alone = F.array(F.struct(F.trim(F.col(name)).alias("alias"), F.lit(False).alias("case_sensitive")))
    hit = F.exists(F.coalesce("_aliases", alone), lambda a: F.regexp_like(F.col(text), F.concat(F.when(a["case_sensitive"], F.lit("")).otherwise(F.lit("(?i)")), bounded(a["alias"]))))
    return joined.withColumn("mentioned", F.coalesce(hit, F.lit(False))).drop("_key", "_canonical", "_aliases")


def bounded(alias: Column) -> Column:
    """Pattern of an alias that must not touch letters or digits, nor + or # if
    it ends with one of those; spaces and hyphens are interchangeable."""
    core = F.array_join(F.transform(F.split(alias, r"[\s-]+"), lambda w: F.regexp_replace(w, r"([^0-9A-Za-z])", r"\\$1")), r"[\s-]+")
    return F.concat(F.lit("(?<![0-9A-Za-z])"), core, F.lit("(?![0-9A-Za-z])"), F.when(alias.rlike("[0-9A-Za-z]$"), F.lit("(?![+#])")).otherwise(F.lit("")))


def mentions(text: Column, name: str) -> Column:
    """Bounded mention of a name that is in no vocabulary."""
    tail = r"(?![0-9A-Za-z+#])" if name[-1:].isalnum() else "(?![0-9A-Za-z])"
    return text.rlike("(?i)(?<![0-9A-Za-z])" + quote(name).replace(r"\ ", " ").replace(" ", r"[\s-]+") + tail)


def clean_skill_lists(rows: DataFrame, profile_terms: list[str], vocabulary_names: list[str]) -> DataFrame:
    """Drop "missing" skills that the profile has and "matched" ones it lacks;
    only vocabulary names are judged.  Adds changed."""
    have, known = F.array(*[F.lit(x.lower()) for x in profile_terms]), F.array(*[F.lit(x.lower()) for x in vocabulary_names])
    inside = lambda a, x: F.array_contains(a, F.lower(x))
    matched = F.filter("matched_skills", lambda x: ~inside(known, x) | inside(have, x))
    missing = F.filter("missing_skills", lambda x: ~inside(known, x) | ~inside(have, x))
    out = rows.withColumns({"_m": matched, "_n": missing})
    return out.withColumn("changed", (F.size("_m") != F.size("matched_skills")) | (F.size("_n") != F.size("missing_skills"))).withColumns({"matched_skills": F.col("_m"), "missing_skills": F.col("_n")}).drop("_m", "_n")
