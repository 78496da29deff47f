"""Benchmark decontamination by greedy string tiling (operator 4).

Texts are lower-cased sequences of word tokens, kept as 64-bit hashes.  A
document and a benchmark item meet in a join on seeds, runs of ``least`` tokens;
a shorter item is a single seed and must stand in a document as a whole.  A pair
whose shared seeds could cover enough of the item is tiled: running Karp-Rabin
hashes find the longest common runs of tokens that no tile covers yet, the
longest are marked first, the search length is halved down to ``least``.  Tiles
may lie in any order, so a passage whose sentences were shuffled is covered as
well as a verbatim one.  A pair counts when tiles cover at least ``threshold``
of the item's tokens.

Seeds that no item has are left out before the join where the benchmark has at
most ``local_seeds`` tokens (measured): then only the documents that hold some
seed are moved at all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import parts
from millrace.llm.pretok import Memo
from millrace.llm.rolling import running, windows
from millrace.runtime import cut, packed, ship, unpacked

WORD = re.compile(r"[^\W_]+")
LEAST, THRESHOLD = 5, 0.5


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def new_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def tokens(text: str | None, memo: Memo) -> np.ndarray:
    """Hashes of the words of a text."""
    ws = words(text)
    return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))


def seeds(x: np.ndarray, n: int) -> np.ndarray:
    """Seed of every window of ``n`` tokens; seeds of unequal lengths differ."""
    with np.errstate(over="ignore"):
        return windows(running(x), n) ^ (np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F))


def free_windows(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of ``n`` positions none of which is marked."""
    if len(marked) < n:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[n:] == total[:-n])


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (item start, doc start,
    length) of non-overlapping common runs of at least ``least`` tokens,
    longest first, leftmost on ties."""
    marked_i, marked_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    hashes = running(item), running(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)))
    while len(item) >= least and len(doc) >= least:
        found = matches(item, doc, marked_i, marked_d, hashes, size)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        progress = False
        for i, d, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if not marked_i[i : i + n].any() and not marked_d[d : d + n].any():
                marked_i[i : i + n] = marked_d[d : d + n] = True
                tiles.append((i, d, n))
                progress = True
        if progress:
            continue  # what an occluded match left over may still be long enough
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def matches(item: np.ndarray, doc: np.ndarray, marked_i: np.ndarray, marked_d: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """Maximal common unmarked runs of at least ``size`` tokens."""
    free_i, free_d = free_windows(marked_i, size), free_windows(marked_d, size)
    if not len(free_i) or not len(free_d):
        return []
    hash_i, hash_d = windows(hashes[0], size)[free_i], windows(hashes[1], size)[free_d]
    order = np.argsort(hash_i, kind="stable")
    first, last = np.searchsorted(hash_i[order], hash_d, "left"), np.searchsorted(hash_i[order], hash_d, "right")
    out = []
    for k in np.flatnonzero(last > first):
        d = int(free_d[k])
        for i in free_i[order[first[k] : last[k]]].tolist():
            if i and d and item[i - 1] == doc[d - 1] and not marked_i[i - 1] and not marked_d[d - 1]:
                continue  # part of the run that starts one earlier
            most = min(len(item) - i, len(doc) - d)
            stop = (item[i : i + most] != doc[d : d + most]) | marked_i[i : i + most] | marked_d[d : d + most]
            n = int(stop.argmax()) if stop.any() else most
            if n >= size:
                out.append((i, d, n))
    return out


def benchmark_items(benchmark: DataFrame, least: int) -> DataFrame:
    """(i, item_id, x, n, seed_length) of every item row that has a token; x are
    the token hashes."""
    def run(batches):
        memo = new_memo()
        for b in batches:
            xs = [tokens(t, memo) for t in b.column(1).to_pylist()]
            at = [k for k, x in enumerate(xs) if len(x)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([xs[k].view(np.int64) for k in at], pa.list_(pa.int64()))], names=["item_id", "x"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, x array<long>")
    return cut(rows.select(F.monotonically_increasing_id().alias("i"), "item_id", "x", F.size("x").alias("n"), F.least(F.size("x"), F.lit(least)).alias("seed_length")))


def item_seeds(items: DataFrame) -> DataFrame:
    """(i, n, seed, most): the distinct seeds of each item, and how many of its
    tokens a seed's places can cover at most."""
    def run(batches):
        for b in batches:
            out = []
            for i, x, n, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for seed, places in zip(*np.unique(seeds(np.array(x, np.int64).view(np.uint64), size), return_counts=True), strict=True):
                    out.append((i, n, int(seed.astype(np.int64)), int(places) * size))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["i", "n", "seed", "most"])

    return items.select("i", "x", "n", "seed_length").mapInArrow(run, "i long, n long, seed long, most long")


def documents_with_seeds(docs: DataFrame, lengths: list[int], wanted) -> DataFrame:
    """(doc_id, x, seeds) of the documents that hold a wanted seed; ``wanted`` is
    a broadcast sorted array of seeds, or None if all count."""
    def run(batches):
        memo = new_memo()
        for b in parts(batches):
            at, xs, found = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                x = tokens(text, memo)
                h = np.unique(np.concatenate([seeds(x, n) for n in lengths])).view(np.int64)
                if wanted is not None:
                    here = np.searchsorted(wanted.value, h)
                    h = h[(here < len(wanted.value)) & (wanted.value[np.minimum(here, len(wanted.value) - 1)] == h)]
                if len(h):
                    at.append(k)
                    xs.append(x.view(np.int64))
                    found.append(h)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(xs, lists), pa.array(found, lists)], names=["doc_id", "x", "seeds"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<long>, seeds array<long>")


RESULT = "item_tokens int, covered_tokens int, n_tiles int, coverage double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, local_seeds: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage of every
    pair with coverage of at least ``threshold``.

    Null and empty texts and items without tokens take no part; an item of fewer
    than ``least`` tokens must stand in the document as a whole; a null id is
    kept as null.  A document row that repeats gives repeated rows (one per row
    and item), and so does a repeated item row.
    """
    spark = ship(docs.sparkSession)
    items = benchmark_items(benchmark, least)
    facts = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set("seed_length").alias("lengths")).first()
    keys = cut(item_seeds(items))
    wanted = None
    if facts.n <= local_seeds:
        wanted = spark.sparkContext.broadcast(np.unique(keys.select("seed").distinct().toArrow().column("seed").to_numpy()))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, {RESULT}"
    if not facts.n:
        return spark.createDataFrame([], kinds)
    # row numbers must not change when a task is repeated
    holding = cut(documents_with_seeds(docs, sorted(facts.lengths), wanted).withColumn("d", F.monotonically_increasing_id()))
    met = holding.select("d", F.explode("seeds").alias("seed")).join(keys, "seed")
    pairs = met.groupBy("d", "i").agg(F.sum("most").alias("most"), F.any_value("n").alias("n")).where(F.col("most") >= threshold * F.col("n")).select("d", "i")
    both = pairs.join(holding.select("d", "doc_id", "x"), "d").join(items.withColumnRenamed("x", "y"), "i").select("doc_id", "item_id", "x", "y", "seed_length")

    def run(batches):
        for b in parts(batches):
            at, got = [], []
            for k, (x, y, n) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                tiles = tile(np.array(y, np.int64), np.array(x, np.int64), n)
                covered = sum(size for _, _, size in tiles)
                if covered >= threshold * len(y):
                    at.append(k)
                    got.append((len(y), covered, len(tiles)))
            take = pa.array(at, pa.int64())
            size, covered, tiles = (np.array(c, np.int32) for c in (zip(*got, strict=True) if got else [(), (), ()]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(size), pa.array(covered), pa.array(tiles), pa.array(covered / np.maximum(size, 1), pa.float64())],
                names=["doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage"])

    return both.mapInArrow(run, kinds)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, local_seeds: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose text covers some benchmark item; rows
    with null or empty texts stay.  The text decides: ids may be null or repeat."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))  # 128 bits
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark, least, threshold, local_seeds)
    bad = cut(leaks.select("doc_id.*").distinct())
    return unpacked(packed(docs, k1=key["k1"], k2=key["k2"]).join(bad, ["k1", "k2"], "left_anti"), docs.columns)


def op4_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every contaminated (document, item) pair."""
    return find_leaks(docs, benchmark)
