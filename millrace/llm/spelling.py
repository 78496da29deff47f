"""Spelling variants grouped by PartEnum signatures (operator 13).

Words are counted over whole texts.  A word's letter multiset is a binary vector
with one dimension per (letter, occurrence); one inserted, deleted or replaced
letter changes at most two dimensions.  The dimensions are dealt to ``PARTS``
parts.  For every two parts the rest of the vector is a signature, so vectors at
a Hamming distance of at most two agree in at least one of them.

Words with one multiset share a row: signatures are made, equi-joined and
verified per distinct multiset, each pair is kept once, and only then its words
meet and are compared letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import parts
from millrace.llm.rolling import powers, running
from millrace.runtime import cut, discard, ship

PARTS = 10  # 45 signatures, each of eight tenths of the dimensions
EVERY = 97

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = True
LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF, and of nothing else
_POLY = 0xEDB88320


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc_of_runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray, longest: int = 64) -> np.ndarray:
    """crc32 of every ``x[start:end]``, each continued from the crc in ``state``.

    All runs take their next byte together; the few longer ones than ``longest``
    are left to zlib."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -longest) :]
    at, crc = starts[order], ~state[order]
    left = len(order)
    lens = size[order]
    for j in range(int(lens[0]) if left else 0):
        left = int(np.searchsorted(-lens, -j))  # runs with more than j bytes come first
        crc[:left] = CRC[(crc[:left] ^ x[at[:left] + j]) & np.uint32(255)] ^ (crc[:left] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > longest).tolist():
        out[i] = zlib.crc32(x[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters in UTF-8 bytes."""
    lead = x == LEAD
    inside = LETTER[x] | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def count_part(ids: list, texts: list[bytes | None], every: int) -> Counter:
    """Words of a few texts and how often they occur, after deletions."""
    raws = [t or b"" for t in texts]
    x = LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
    starts, ends = runs(x)
    if not len(starts):
        return Counter()
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, "right")
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc_of_runs(x, starts, ends, seeds[doc])
    cut_out = crc % np.uint32(every) == 0
    prefix, (_, down) = running(x), powers(len(x) + 1)
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    out: Counter = Counter()
    whole = np.flatnonzero(~cut_out)
    _, first, n = np.unique(h[whole], return_index=True, return_counts=True)
    data = x.tobytes()
    for i, k in zip(whole[first].tolist(), n.tolist(), strict=True):
        out[data[starts[i] : ends[i]].decode()] += k
    for i in np.flatnonzero(cut_out).tolist():
        w = data[starts[i] : ends[i]].decode()
        at = int(crc[i]) % len(w)
        out[w[:at] + w[at + 1 :]] += 1
    return out


def count_words(docs: DataFrame, every: int = EVERY, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters and ``least`` occurrences.

    A word is a maximal run of ``A-Z a-z U+00C0-U+00FF`` of the whole text with
    A-Z lowered.  Where ``every`` divides the crc32 of ``<doc_id>:<word>`` one
    letter of it is deleted (the crc modulo the length says which) and the result
    counted instead.  Null texts hold no words; a null id is written as nothing;
    repeated rows count again.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in parts(batches):
            got = [(w, k) for w, k in count_part(b.column(0).to_pylist(), b.column(1).to_pylist(), every).items() if len(w) >= shortest]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([k for _, k in got], pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def multiset(word: Column) -> Column:
    """A word's letters in order, as one string."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def near_multisets(words: DataFrame) -> DataFrame:
    """(a, b): every two letter multisets, a < b, of which one letter more, less
    or other makes one into the other; ``words`` is (letters) of distinct ones."""
    letters = F.split("letters", "")  # in order, so that equal ones stand together
    first = F.transform(F.array_distinct(letters), lambda x: F.struct(x.alias("ch"), (F.array_position(letters, x) - 1).cast("int").alias("at")))
    ends = lambda i: F.coalesce(F.try_element_at(F.col("first"), i + 2)["at"], F.length("letters"))
    of = lambda x, i: F.transform(F.sequence(F.lit(0), ends(i) - x["at"] - 1), lambda k: F.struct(x["ch"].alias("ch"), k.alias("occ")))
    dims = words.select("letters", first.alias("first")).select("letters", F.flatten(F.transform("first", of)).alias("dims"))
    hashed = F.transform("dims", lambda d: F.struct(F.xxhash64(d["ch"], d["occ"]).alias("h"), F.pmod(F.xxhash64(d["occ"], d["ch"]), F.lit(PARTS)).alias("part")))
    dims = dims.select("letters", F.transform("dims", lambda d: F.xxhash64(d["ch"], d["occ"])).alias("bits"), hashed.alias("placed"))
    rest = lambda i, j: F.aggregate(F.filter("placed", lambda d: ~d["part"].isin(i, j)), F.lit(i * PARTS + j).cast("long"), lambda s, d: F.xxhash64(s, d["h"]))
    signed = dims.select("letters", "bits", F.explode(F.array(*[rest(i, j) for i, j in combinations(range(PARTS), 2)])).alias("sig"))
    signed = cut(signed.select("sig", "letters", F.array_sort("bits").alias("bits"), F.length("letters").alias("len")))
    l, r = ([signed.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("letters", "bits", "len")]) for x in "ab"])
    met = l.join(r.hint("merge"), "sig").where("letters_a < letters_b and abs(len_a - len_b) <= 1")
    shared = F.size(F.array_intersect("bits_a", "bits_b"))
    near = cut(met.where(shared >= F.greatest("len_a", "len_b") - 1).select(F.col("letters_a").alias("a"), F.col("letters_b").alias("b")).distinct())
    discard(signed)
    return near


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all words of ``words`` (word,
    n; distinct) that one inserted, deleted or replaced letter apart."""
    named = cut(words.select("word", "n", multiset(F.col("word")).alias("letters")))
    pairs = near_multisets(named.select("letters").distinct())
    a, b = (named.select(F.col("letters").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    ends = lambda x, y: F.struct(F.col(f"word_{x}").alias("word"), F.col(f"n_{x}").alias("n"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("near_n"))
    return met.select(F.inline(F.array(ends("a", "b"), ends("b", "a"))))


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n).

    A word's form is the commonest word near it (ties: the first in code-point
    order), if that is at least ``factor`` times as common; following forms ends
    at its root.  Counts grow along forms, so there are no circles.  Words without
    near words have null forms and are their own roots.
    """
    words = cut(words)
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    best = cut(best.select("word", "n_near", F.when(-F.col("best.rank") >= factor * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))).alias("to")))
    forms = best.where("to is not null").select("word", F.col("to.form").alias("root"))
    deepest = math.log(max(2, words.agg(F.max("n")).first()[0] or 0), factor)  # forms on a way are at most so many
    for _ in range(math.ceil(math.log2(deepest + 1))):
        forms = cut(forms.join(forms.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = words.join(best.hint("merge"), "word", "left").join(forms.hint("merge"), "word", "left")
    return out.select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("to.form_n").alias("form_n"))


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    return group_variants(count_words(docs))
