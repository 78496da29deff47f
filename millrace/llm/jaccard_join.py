"""N-gram Jaccard join with vertical partitioning (operator 2).

Texts are sets of word n-grams, kept as 64-bit hashes.  One global order of all
n-grams is cut into fragments: the head fragment (a quarter of the hash space)
comes first and is ordered by document frequency, rare first; the others follow
in hash order.  Two sets with Jaccard >= t share an n-gram among the first
n - ceil(t * n) + 1 of each, so candidates come from a join on those prefixes,
which lie in the head fragment but for small sets.

The overlap of a candidate pair is counted fragment by fragment and the partial
counts are summed per pair.  The head fragment is counted first; a pair that
cannot link any more even if all its other n-grams were shared ends there, and
only for the rest do the segments of the other fragments meet, each in its own
row and task.  Texts never take part in pair joins: a set is made once, and its
segments (class, fragment, n-grams) move.

Equal sets form one class and are joined once.  Copies are not expanded into
all pairs: in a group of sets that share a prefix n-gram a pivot is compared
with the others.  Only groups whose members are not all connected by then are
compared further, in blocks bounded in sets and in n-grams, whose overlaps are
again counted fragment by fragment; a block returns a spanning star of what it
linked.  The components so equal those of the full join.

Components, links and classes stay distributed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import parts
from millrace.llm.graph import components
from millrace.llm.rolling import BASE, powers, running
from millrace.runtime import cut, discard, packed, ship, unpacked

MIX = np.uint64(0xFF51AFD7ED558CCD)
HEAD, FRAGMENTS = 4, 4  # one hash in HEAD is in the head fragment


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of word n-grams of many texts at once.

    Words are hashed by differences of one running polynomial over all bytes of
    a slice of texts, n-grams by shifted sums over word hashes."""

    def __init__(self, n: int, slice_bytes: int = 1 << 19):
        self.n, self.slice_bytes = n, slice_bytes

    def sets(self, raws: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct hashes per text; the whole sequence as one n-gram if
        a text has fewer than ``n`` words; empty without words."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for r in raws:
            part.append(r or b"")
            size += len(part[-1]) + 1
            if size >= self.slice_bytes:
                out += self._slice(part)
                part, size = [], 0
        return out + (self._slice(part) if part else [])

    def _slice(self, raws: list[bytes]) -> list[np.ndarray]:
        x = LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        edge = np.diff(np.concatenate([[True], SPACE[x], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        with np.errstate(over="ignore"):
            prefix, (_, down) = running(x), powers(len(x) + 1)
            words = _mixed((prefix[ends] - prefix[starts]) * down[starts])
            limits = np.cumsum([len(r) + 1 for r in raws])
            doc = np.searchsorted(limits, starts, "right")
            per = np.bincount(doc, minlength=len(raws))
            first = np.concatenate([[0], np.cumsum(per)[:-1]])
            out = [np.zeros(0, np.uint64)] * len(raws)
            for size in range(1, self.n):
                owner = np.flatnonzero(per == size)
                for i, h in zip(owner.tolist(), self._grams(words, first[owner], size), strict=True):
                    out[i] = h[None]
            at = np.arange(max(0, len(words) - self.n + 1))
            at = at[doc[at] == doc[at + self.n - 1]]
            h = self._grams(words, at, self.n)
        counts = np.maximum(per - self.n + 1, 0)
        stops = np.cumsum(counts)
        for i in np.flatnonzero(counts).tolist():
            part = np.sort(h[stops[i] - counts[i] : stops[i]])
            out[i] = part[np.concatenate([[True], part[1:] != part[:-1]])]
        return out

    @staticmethod
    def _grams(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = h * BASE + words[at + k]
            return _mixed(h)


def needed(n: int, percent: int) -> int:
    """ceil(percent / 100 * n) in integers."""
    return -(-n * percent // 100)


def fragment_of(h: np.ndarray) -> np.ndarray:
    """0 for the head fragment, then equal parts of the remaining hash space."""
    rest = (h >> np.uint64(8)) % np.uint64(FRAGMENTS - 1) + np.uint64(1)
    return np.where(h % np.uint64(HEAD) == 0, 0, rest.astype(np.int64))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=24).digest()


def class_id(digest: bytes, moved: frozenset) -> int:
    """64-bit name of a set; classes in ``moved`` (whose first names clashed)
    take other bytes of their digest."""
    part = digest[8:16] if digest in moved else digest[:8]
    return int.from_bytes(part, "big", signed=True)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text key and binary text; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.cast("binary").alias("raw"))


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


def describe(rows: DataFrame, n: int, percent: int, moved: frozenset = frozenset()) -> DataFrame:
    """(doc_id, t, n, c, digest, m, head): set size, class (null if empty), full
    digest, number of n-grams in the head fragment, and these n-grams followed by
    as many of the next fragments as the prefix needs.  A task gives the n-grams
    of a class once."""
    def run(batches):
        shingler, seen = Shingler(n), set()
        for b in parts(batches):
            out = []
            for s in shingler.sets(b.column(2).to_pylist()):
                d = _digest(s)
                if not len(s):
                    out.append((0, None, d, 0, None))
                    continue
                c, frag = class_id(d, moved), fragment_of(s)
                head, take = s[frag == 0], None
                if c not in seen:
                    seen.add(c)
                    take, lacks = head, prefix_length(len(s), percent) - len(head)
                    if lacks > 0:
                        rest = s[frag > 0]
                        take = np.concatenate([head, rest[np.lexsort((rest, frag[frag > 0]))][:lacks]])
                    take = take.view(np.int64)
                out.append((len(s), c, d, len(head), take))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "t", "n", "c", "digest", "m", "head"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t long, n long, c long, digest binary, m int, head array<long>")


def prefixes(info: DataFrame, percent: int) -> DataFrame:
    """(s, c, n): prefix n-grams that at least two classes may share."""
    heads = info.where("head is not null").select(F.explode("head").alias("s"), "c", F.col("n").cast("int").alias("n"), "m")
    counts = cut(heads.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    shared = heads.join(counts, "s").dropDuplicates(["c", "s"])
    own = Window.partitionBy("c")
    ranked = shared.withColumn("k", F.row_number().over(own.orderBy("df", "s"))).withColumn("found", F.count("*").over(own))
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    # n-grams that no other class has come first in the order, as the rarest
    inside = (F.col("m") < prefix) | (F.col("m") - F.col("found") + F.col("k") <= prefix)
    out = cut(ranked.where(inside).select("s", "c", "n"))
    discard(counts)
    return out


def segments(texts: DataFrame, n: int, moved: frozenset) -> DataFrame:
    """(c, f, grams) of classes (c, raw): the set's n-grams in fragment f, sorted;
    one row per fragment that is not empty."""
    def run(batches):
        shingler = Shingler(n)
        for b in parts(batches):
            cs, fs, grams = [], [], []
            for c, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1).to_pylist()), strict=True):
                if class_id(_digest(s), moved) != c:
                    continue  # a text that is not the class's own stands under an equal text key
                frag = fragment_of(s)
                for f in np.unique(frag).tolist():
                    cs.append(c)
                    fs.append(f)
                    grams.append(s[frag == f].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(fs, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["c", "f", "grams"])

    return texts.mapInArrow(run, "c long, f int, grams array<long>")


def partial_overlaps(pairs: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (a, b and others) with ``part``, the number of n-grams that the
    two ends' rows of ``parts`` (c, grams and ``keys``) share; pairs without such
    rows on both sides are left out."""
    ends = [parts.select(F.col("c").alias(x), F.col("grams").alias(f"grams_{x}"), *keys).hint("merge") for x in "ba"]
    both = pairs.join(ends[0], ["b", *keys]).join(ends[1], ["a", *keys])
    return both.withColumn("part", F.size(F.array_intersect("grams_a", "grams_b")).cast("long")).drop("grams_a", "grams_b")


def linked(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, fits): distinct pairs of each group's pivot (the member that
    is first by a hash, so that groups of the same sets agree) with its others;
    fits tells whether their sizes let them link."""
    first = members.groupBy("s").agg(F.min(F.struct(F.xxhash64("c").alias("r"), "c", "n")).alias("p"))
    chosen = first.select("s", F.col("p.c").alias("p"), F.col("p.n").alias("np"))
    pairs = members.join(chosen.hint("merge"), "s").where("c <> p")
    a = F.col("c") < F.col("p")
    ends = lambda x, y: F.when(a, F.col(x)).otherwise(F.col(y))
    return pairs.select(ends("c", "p").alias("a"), ends("p", "c").alias("b"), ends("n", "np").alias("na"), ends("np", "n").alias("nb")).distinct().withColumn(
        "fits", F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))


BLOCK, BLOCK_GRAMS = 512, 1_000_000  # sets and n-grams of a block
BANDS = (1 << 16) - 1  # bits of a block's number that hold its band of sizes


def local_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two blocks link: overlaps are counted fragment by
    fragment as products of incidence matrices, and summed."""
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (sets_a, sets_b))
    total = np.zeros((len(na), len(nb)), np.int64)
    ha, hb = np.concatenate(sets_a), np.concatenate(sets_b)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    fa, fb = fragment_of(ha), fragment_of(hb)
    for f in range(FRAGMENTS):
        shared = np.intersect1d(ha[fa == f], hb[fb == f])
        for at in range(0, len(shared), 2048):
            grams = shared[at : at + 2048]
            total += np.rint(_incidence(ha, ra, grams, len(na)) @ _incidence(hb, rb, grams, len(nb)).T).astype(np.int64)
    return linked(total, na[:, None], nb[None, :], percent)


def _incidence(h: np.ndarray, row: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
    hit = grams[at] == h
    out = np.zeros((rows, len(grams)), np.float32)
    out[row[hit], at[hit]] = 1
    return out


def local_stars(pdf):
    """Edges (a, b) that connect what is linked between the two blocks of a group."""
    import pandas as pd

    sets = [np.asarray(g).view(np.uint64) for g in pdf.grams]
    c, k = pdf.c.to_numpy(np.int64), pdf.k.to_numpy()
    ia, ib = np.flatnonzero(k == pdf.i.to_numpy()), np.flatnonzero(k == pdf.j.to_numpy())
    if not len(ia) or not len(ib):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    hit = local_links([sets[i] for i in ia], [sets[i] for i in ib], int(pdf.percent.iloc[0]))
    low = c.copy()
    while True:  # smallest class reachable inside the group
        down = np.where(hit, low[ia][:, None], np.iinfo(np.int64).max).min(0)
        new = low.copy()
        new[ib] = np.minimum(new[ib], down)
        up = np.where(hit, new[ib][None, :], np.iinfo(np.int64).max).min(1)
        new[ia] = np.minimum(new[ia], up)
        if (new == low).all():
            break
        low = new
    part = low != c
    return pd.DataFrame({"a": low[part], "b": c[part]})


def open_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(s, c, n, root) of the groups that hold several components; of groups with
    the same members (told by sums of two hashes) one."""
    now = members.join(roots.withColumnRenamed("v", "c").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    sums = [F.sum(F.xxhash64("c", F.lit(k)).cast("decimal(20,0)")).alias(f"sum{k}") for k in (1, 2)]
    spread = now.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *sums).where("lo <> hi")
    once = spread.groupBy("sum1", "sum2").agg(F.min("s").alias("s")).select("s")
    return cut(now.join(once.hint("merge"), "s").select("s", "c", "n", "root"))


def meetings(now: DataFrame, percent: int) -> DataFrame:
    """(c, k, x): each set of the open groups with its block and the blocks that
    it must meet.

    Sets go to blocks by the first n-gram of their open groups, so that alike
    sets lie together; an n-gram with more sets than a block holds gets several
    blocks, rarer ones share blocks.  Only sets of different components need to
    be compared: in a group a set outside the largest component meets the blocks
    of all members, and a set of the largest one those of the others."""
    weight = F.greatest(F.lit(1 / BLOCK), F.any_value("n") / BLOCK_GRAMS)
    ratio = math.log(100 / (percent - 1))  # a little more than sets that link can differ by
    band = F.floor(F.ln(F.any_value("n")) / ratio).cast("long")
    own = cut(now.groupBy("c").agg(F.min("s").alias("s"), weight.alias("w"), band.alias("band")).withColumn("key", F.xxhash64("s", "band")))
    keys = own.groupBy("key").agg(F.sum("w").alias("of_key"))
    of_band = own.groupBy("band").agg(F.ceil(F.sum("w")).cast("long").alias("n")).collect()  # one row per order of size
    buckets = F.element_at(F.create_map(*[F.lit(x).cast("long") for r in of_band for x in (r.band, r.n)]), F.col("band"))
    part = F.pmod(F.xxhash64("c"), F.ceil("of_key").cast("long"))
    k = F.when(F.col("of_key") > 1, F.xxhash64("key", part)).otherwise(F.xxhash64(F.pmod(F.col("key"), buckets), "band"))
    blocks = own.join(keys.hint("merge"), "key").select("c", k.bitwiseAND(F.lit(~BANDS)).bitwiseOR(F.col("band")).alias("k"))
    largest = now.groupBy("s", "root").agg(F.count("*").alias("n")).groupBy("s").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    rows = now.select("s", "c", "root").join(blocks.hint("merge"), "c").join(largest.hint("merge"), "s").select("s", "c", "k", (F.col("root") != F.col("largest")).alias("apart"))
    rows = cut(rows)
    of_group = rows.groupBy("s").agg(F.collect_set("k").alias("every"), F.collect_set(F.when(F.col("apart"), F.col("k"))).alias("others"))
    near = lambda x: F.abs(x.bitwiseAND(F.lit(BANDS)) - F.col("k").bitwiseAND(F.lit(BANDS))) <= 1
    wanted = F.filter(F.when(F.col("apart"), F.col("every")).otherwise(F.col("others")), near)
    # blocks are gathered per set before they become rows: a set has few groups, and alike groups the same blocks
    met = rows.join(of_group.hint("merge"), "s").select("c", "k", wanted.alias("xs")).groupBy("c", "k").agg(F.array_distinct(F.flatten(F.collect_set("xs"))).alias("xs"))
    return cut(met.select("c", "k", F.explode("xs").alias("x")))


def block_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what is linked in the open groups.

    met: (c, k, x) of ``meetings``; sets: (c, grams).  Every two blocks that meet
    form a group of two bounded blocks, which returns a spanning star per
    connected part."""
    rows = met.join(sets.hint("merge"), "c").select(F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), "k", "c", "grams", F.lit(percent).alias("percent"))
    return rows.groupBy("i", "j").applyInPandas(local_stars, "a long, b long")


def links(members: DataFrame, info: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int, moved: frozenset) -> DataFrame:
    """(v, root): components of the classes that have a link.

    ``members`` (s, c, n) are the groups of classes that share a prefix n-gram.
    First one pivot per group is compared with the other members.  Groups that
    still hold several components are compared exactly, block by block.
    """
    pairs = cut(pivot_pairs(members, percent))
    heads = info.where("head is not null").select("c", F.slice("head", F.lit(1), F.col("m")).alias("grams"), "m")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    heads = heads.join(ends.hint("merge"), "c").groupBy("c").agg(F.any_value("grams").alias("grams"), F.any_value("m").alias("m"))
    sized = [heads.select(F.col("c").alias(x), F.col("grams").alias(f"grams_{x}"), F.col("m").alias(f"m{x}")).hint("merge") for x in "ba"]
    first = pairs.where("fits").join(sized[0], "b").join(sized[1], "a").withColumn("part", F.size(F.array_intersect("grams_a", "grams_b")).cast("long"))
    most = F.col("part") + F.least(F.col("na") - F.col("ma"), F.col("nb") - F.col("mb"))
    first = cut(first.where(linked(most, F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "part"))
    wanted = ends.join(classes.hint("merge"), "c").select("c", F.col("at.t").alias("t"), F.coalesce(F.col("at.doc_id").cast("string"), F.lit("")).alias("_id"))
    texts = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(wanted, ["t", "_id"]).select("c", "raw")
    kept = cut(segments(texts, n, moved).dropDuplicates(["c", "f"]))
    rest = first.select("a", "b", "na", "nb", F.explode(F.array(*[F.lit(f) for f in range(1, FRAGMENTS)])).alias("f"))
    more = partial_overlaps(rest, kept.where("f > 0"), ["f"]).select("a", "b", "na", "nb", "part")
    counted = first.unionByName(more).groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    edges = cut(counted.where(linked(F.col("overlap"), F.col("na"), F.col("nb"), percent)).select("a", "b"))
    discard(pairs, first)
    roots = components(edges)
    now = open_groups(members, roots)
    if now.isEmpty():
        discard(edges, kept, now)
        return roots
    met = meetings(now, percent)
    whole = kept.join(met.select("c").distinct().hint("merge"), "c").groupBy("c").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    found = cut(edges.unionByName(block_links(met, whole, percent)))
    discard(edges, kept, now, roots, met)
    out = components(found)
    discard(found)
    return out


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, t, n_shingles, component_id, root of every row of ``docs``
    (doc_id, text); t is the text's 64-bit key, root a name of the component
    (null for empty sets).

    Words are split at 0x20 and 0x09-0x0D after lowering A-Z.  Rows link when
    100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id reachable, the row's own included.  Null and empty texts are empty
    sets, linked with nothing.  Repeated rows are linked with each other; null
    ids take part and yield to any other id of their component.  ``percent`` is
    an integer.
    """
    ship(docs.sparkSession)
    rows = _rows(docs)
    info = cut(describe(rows, n, percent))
    clash = info.where("c is not null").groupBy("c").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    moved = frozenset(bytes(x) for r in clash.select("c").join(info, "c").select("digest").distinct().collect() for x in r)
    if moved:  # about one set in 2^64 / (number of sets)
        info = cut(describe(rows, n, percent, moved))
    slim = cut(info.select("doc_id", "t", "n", "c"))
    kept = slim.where("c is not null")
    classes = cut(kept.groupBy("c").agg(F.min("doc_id").alias("first"), F.min(F.struct("t", "doc_id")).alias("at")))
    members = prefixes(info, percent)
    roots = links(members, info, rows, classes, n, percent, moved)
    discard(members, info)
    named = classes.join(roots.withColumnRenamed("v", "c").hint("merge"), "c", "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(smallest.hint("merge"), "root").select("c", "component_id", "root")
    full = kept.join(names, "c").select("doc_id", "t", F.col("n").alias("n_shingles"), "component_id", "root")
    empty = slim.where("c is null").select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.unionByName(empty)


def op2_jaccard_join(docs: DataFrame) -> DataFrame:
    """4-word shingles, 85 percent."""
    return join(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of linked rows: the smallest
    (doc_id, text key), null ids last; of repeated rows one.  Rows with empty
    texts are linked with nothing and stay.

    The (id, text key) pairs that go or repeat meet the documents in a join on
    the key; Spark broadcasts them if they are small.
    """
    rows = cut(join(docs, n, percent).where("root is not null").select("root", "doc_id", "t"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    keys = rows.groupBy("root", "doc_id", "t").agg(F.count("*").alias("copies"))
    first = rows.groupBy("root").agg(F.min(order).alias("w"))
    wins = F.col("w.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("w.t") == F.col("t"))
    marked = cut(keys.join(first.hint("merge"), "root").withColumn("wins", wins).where("not wins or copies > 1").select("doc_id", "t", "wins"))
    here = packed(docs, k=F.xxhash64(F.coalesce("text", F.lit(""))))
    both = here.join(marked, (F.col("k") == F.col("t")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left")
    single = both.where("wins is null")
    repeated = both.where("wins").dropDuplicates(["doc_id", "t"])
    return unpacked(single.select("row").unionByName(repeated.select("row")), docs.columns)
