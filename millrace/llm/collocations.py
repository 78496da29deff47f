"""Phrase collocations from sorted count streams (operator 11).

Phrases are counted order by order.  A phrase is only as frequent as its parts,
so a pass counts those phrases alone whose two parts, one word shorter, may be
frequent; a bitmap of bounded size tells which may.  Tasks count sorted runs of
dense word numbers and hand on distinct phrases; Spark adds them up.

The frequent phrases of all orders then stand in one stream in prefix order,
where every beginning of a phrase comes before it: its left counts are the last
counts seen per order, and a right extension that is as frequent is the next
row.  The same pass in suffix order gives right counts and left extensions.  No
counts are looked up in hash tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import parts
from millrace.llm.ordered import in_ranges, scan
from millrace.llm.rolling import BASE, powers, running
from millrace.runtime import cut, default_parallelism, discard, ship

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
BETWEEN = BREAK | np.isin(np.arange(256), [0x20, 0x09])
MIX = np.uint64(0xFF51AFD7ED558CCD)
LEAST_BITS, MOST_BITS = 16, 26  # a bitmap holds 2 ** bits marks: 8 MB at most


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a few texts of one language, and which stand in one piece."""

    def __init__(self, lang: str, texts: list[bytes], salt: int):
        self.x = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        edge = np.diff(np.concatenate([[True], BETWEEN[self.x], [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        seed = running(np.frombuffer(f"{salt}:{lang}".encode(), np.uint8))[-1]
        prefix, (_, down) = running(self.x), powers(len(self.x) + 1)
        with np.errstate(over="ignore"):
            h = (prefix[self.ends] - prefix[self.starts]) * down[self.starts]
            self.h = _mixed(h + _mixed(seed[None]) + (self.ends - self.starts).astype(np.uint64))
        self.piece = np.cumsum(BREAK[self.x])[self.starts]

    def text(self, i: int) -> str:
        return self.x[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def gram_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the ``k`` words from each place ``at``."""
    g = h[at]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            g = _mixed(g * BASE + h[at + j])
    return g


def marked(bitmap: np.ndarray, g: np.ndarray) -> np.ndarray:
    pos = g & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[pos >> np.uint64(6)] >> (pos & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_counts(words: Words, k: int, bitmap: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases of ``k`` words (columns of word hashes) and their counts,
    of those whose two parts of ``k - 1`` words are marked."""
    at = np.arange(max(0, len(words.h) - k + 2))
    ok = marked(bitmap, gram_hashes(words.h, at, k - 1)) & (words.piece[at] == words.piece[at + k - 2])
    at = np.flatnonzero(ok[:-1] & ok[1:] & (words.piece[: max(0, len(ok) - 1)] == words.piece[k - 1 :]))
    if not len(at):
        return [np.zeros(0, np.uint64)] * k, np.zeros(0, np.int64)
    used = np.unique(words.h[np.unique(np.concatenate([at + j for j in range(k)]))])
    key = np.searchsorted(used, words.h[at])
    for j in range(1, k):
        key = key * len(used) + np.searchsorted(used, words.h[at + j])
        if j < k - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [words.h[at[first] + j] for j in range(k)], n


def _by_language(batches, salt: int) -> Iterator[tuple[str, Words]]:
    for b in parts(batches, rows=1 << 14):
        langs = np.array(b.column(0).to_pylist(), object)
        texts = b.column(1)
        for lang in dict.fromkeys(langs.tolist()):
            yield lang, Words(lang, texts.take(pa.array(np.flatnonzero(langs == lang))).to_pylist(), salt)


def count_words(docs: DataFrame, salt: int) -> DataFrame:
    """(h, lang, word, n) of ``docs`` (lang, raw)."""
    def run(batches):
        for lang, words in _by_language(batches, salt):
            h, first, n = np.unique(words.h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([lang] * len(h), pa.string()), pa.array([words.text(i) for i in first.tolist()], pa.string()), pa.array(n, pa.int64())], names=["h", "lang", "word", "n"])

    return docs.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, k: int, bitmap: np.ndarray, salt: int) -> DataFrame:
    """(w1, ..., wk, f) of the phrases of ``k`` words that may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = [f"w{j}" for j in range(1, k + 1)]

    def run(batches):
        for _, words in _by_language(batches, salt):
            cols, n = phrase_counts(words, k, shared.value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in cols], pa.array(n, pa.int64())], names=[*names, "f"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "f"])).groupBy(*names).agg(F.sum("f").alias("f"))


def bitmap_of(grams: DataFrame, k: int) -> np.ndarray:
    """Marks of the rows (w1, ..., wk) of ``grams``: sixteen bits for each, within
    the bounds.  A mark only lets a phrase be counted, so that a full bitmap costs
    time and changes no result."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * grams.count()).bit_length()))

    def run(batches):
        for b in parts(batches, rows=1 << 16):
            h = np.stack([c.to_numpy().view(np.uint64) for c in b.columns[:k]]) if b.num_rows else np.zeros((k, 0), np.uint64)
            g = h[0]
            with np.errstate(over="ignore"):
                for j in range(1, k):
                    g = _mixed(g * BASE + h[j])
            pos = g & np.uint64((1 << bits) - 1)
            word, mask = (pos >> np.uint64(6)).astype(np.int32), np.uint64(1) << (pos & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["i", "m"])

    found = grams.select(*[f"w{j}" for j in range(1, k + 1)]).mapInArrow(run, "i int, m long").groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("i").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (h, lang, word, n), the number of words per language (lang,
    n), and all frequent phrases (w1, ..., w<longest>, k, f)."""
    for salt in range(64):
        counted = cut(count_words(docs, salt))
        if counted.groupBy("h").count().where("count > 1").isEmpty():  # no two words under one number
            break
        discard(counted)
    else:
        raise ValueError("words keep sharing 64-bit numbers")
    totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    words = cut(counted.where(F.col("n") >= least))
    discard(counted)
    orders = [words.select(F.col("h").alias("w1"), F.col("n").alias("f"))]
    for k in range(2, longest + 1):
        orders.append(cut(count_phrases(docs, k, bitmap_of(orders[-1], k - 1), salt).where(F.col("f") >= least)))
        if orders[-1].isEmpty():
            break
    none = {f"w{j}": F.lit(None).cast("long") for j in range(1, longest + 1)}
    same = [o.select(*[F.col(c) if c in o.columns else x.alias(c) for c, x in none.items()], F.lit(k).alias("k"), "f") for k, o in enumerate(orders, 1)]
    every = same[0]
    for o in same[1:]:
        every = every.unionByName(o)
    return words, totals, every


def with_neighbours(phrases: DataFrame, longest: int) -> DataFrame:
    """``phrases`` with ``left`` and ``right``, arrays of the counts of their
    first and last 1, 2, ... words, and ``inside``: whether a phrase with one
    more word before or after is as frequent."""
    w = [f"w{j}" for j in range(1, longest + 1)]
    counts = {f"c{j}": F.when(F.col("k") == j, F.col("f")) for j in range(1, longest)}
    nxt = F.struct("k", "f")
    more = (F.col("next.k") == F.col("k") + 1) & (F.col("next.f") == F.col("f"))
    ahead = scan(in_ranges(phrases, w), w, last=counts, following={"next": nxt})
    ahead = ahead.select(*w, "k", "f", F.array(*counts).alias("left"), F.coalesce(more, F.lit(False)).alias("inside"))
    back = [F.try_element_at(F.reverse(F.slice(F.array(*w), F.lit(1), F.col("k"))), F.lit(j)).alias(f"r{j}") for j in range(1, longest + 1)]
    r = [f"r{j}" for j in range(1, longest + 1)]
    behind = scan(in_ranges(ahead.select("*", *back), r), r, last=counts, following={"next": nxt})
    return behind.select(*w, "k", "f", "left", F.array(*counts).alias("right"), (F.col("inside") | F.coalesce(more, F.lit(False))).alias("inside"))


def cut_scores(k: Column, a: Column, n: Column, left: Column, right: Column, longest: int) -> Column:
    """(score, at, l, r) of the lowest-scoring cut; exact for counts under 10^17."""
    def one(j: int) -> Column:
        l, r = left[j - 1], F.try_element_at(right, (k - j).cast("int"))
        big = lambda c: c.cast("decimal(38,0)")
        return F.when(k > j, F.struct(_div(big(a) * big(n) * F.lit(1000), big(l) * big(r)).alias("score"), F.lit(j).alias("at"), l.alias("l"), r.alias("r")))

    return F.array_min(F.array(*[one(j) for j in range(1, longest)]))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, first: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to ``longest``
    words that occur at least ``least`` times, by language.

    Texts (A-Z lowered) are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
    into words at blanks and tabs; a null lang is ``und``; null and empty texts
    hold no words; repeated rows count again.  n counts the language's words, a,
    l and r are the counts of the phrase and of its two parts at the cut with the
    lowest floor(1000 * a * n / (l * r)), ties to the earliest.  Phrases inside
    longer ones that are as frequent are left out.  Ranked by score, a and phrase
    (UTF-8); ``first`` is the length of the report per language (None: all).
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    words, totals, phrases = frequent(slim, longest, least)
    found = cut(with_neighbours(phrases, longest).where("k > 1 and not inside"))
    named = found.join(words.select(F.col("h").alias("w1"), "lang", F.col("word").alias("t1")).hint("merge"), "w1")
    for j in range(2, longest + 1):
        named = named.join(words.select(F.col("h").alias(f"w{j}"), F.col("word").alias(f"t{j}")).hint("merge"), f"w{j}", "left")
    named = named.join(totals, "lang").select("lang", F.concat_ws(" ", *[f"t{j}" for j in range(1, longest + 1)]).alias("phrase"), F.col("f").alias("a"), "n", cut_scores(F.col("k"), F.col("f"), F.col("n"), F.col("left"), F.col("right"), longest).alias("best"))
    scored = cut(named.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    discard(found)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if first is not None:  # what a share of a language leaves out, the language leaves out
        share = F.pmod(F.xxhash64("phrase"), F.lit(default_parallelism(spark)))
        scored = scored.withColumn("_k", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("_k") <= first).drop("_k")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if first is None else ranked.where(F.col("rank") <= first)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT p, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM listed),
grams AS (
  SELECT w.lang, k.k, array_to_string(list_slice(s.ws, w.i, w.i + k.k - 1), ' ') AS phrase
  FROM words w JOIN listed s USING (p) JOIN (SELECT unnest(range(1, 6)) AS k) k ON w.i + k.k - 1 <= len(s.ws)),
counted AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*)::HUGEINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, t.n, l.f AS l, r.f AS r, s.j, (1000 * c.f * t.n) // (l.f * r.f) AS score
  FROM counted c JOIN totals t USING (lang) JOIN (SELECT unnest(range(1, 5)) AS j) s ON s.j < c.k
  JOIN counted l ON l.lang = c.lang AND l.k = s.j AND l.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), 1, s.j), ' ')
  JOIN counted r ON r.lang = c.lang AND r.k = c.k - s.j AND r.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), s.j + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT DISTINCT c.lang, array_to_string(list_slice(string_split(c.phrase, ' '), s.i, s.i + z.z - 1), ' ') AS phrase, c.f
  FROM counted c JOIN (SELECT unnest(range(1, 5)) AS i) s ON true JOIN (SELECT unnest(range(2, 5)) AS z) z ON z.z < c.k AND s.i + z.z - 1 <= c.k),
kept AS (SELECT b.* FROM best b ANTI JOIN inner_parts x ON x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.f >= 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
