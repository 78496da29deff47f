"""Subword lattice likelihood (operator 1).

The probability of a text is the product over its words and one end mark,
summed over a few hidden strata (languages, say):

    P(text) = sum_k pi_k prod_w P_k(w)
    P_k(w)  = (max(c_k(w) - D_k, 0) + D_k * V_k * B_k(w)) / N_k
    B_k(w)  = (1 - e) * sum over all segmentations of prod p_k(piece)

A word's lattice has an arc for every vocabulary piece that fits, byte arcs for
every character, and an arc for the whole word if the stratum's training texts
hold it.  c_k are training counts, N_k their sum, V_k the number of distinct
tokens, D_k an absolute discount.  B_k is computed by a forward recursion in log
space.  The pieces and their starting weights come from an existing vocabulary
(its scores are merge ranks, read as a Zipf law); forward-backward rounds over
the distinct training words fit the weights, the inventory is never changed.
Pieces that open a word carry the word mark, so that the P_k(w) and P_k(end) of
a stratum add up to one.  The stratum of a text that is scored is not looked
at, it is summed out.

At scale: words are counted with map-side counters and one shuffle.  Only a
bounded number of frequent words (``hot_words``) and the piece weights (as many
as the vocabulary has) reach the driver and every executor.  All other tokens,
summed per document, meet the count table in a shuffled join, and their scores
are summed per document in a second shuffle.  Frequent words, the only ones
that could be skewed, are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut, ship

MARK = "▁"
END_SHARE = 1e-3  # of the fallback distribution
LN10 = math.log(10)
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 64  # words of more characters are taken one at a time


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lowered, split at 0x20 and 0x09-0x0D."""
    return raw.lower().split()


# ---------------------------------------------------------------- the lattice

class Weights:
    """Log-probabilities of pieces (piece, stratum) and bytes (256, stratum)."""

    def __init__(self, names: list[str], pieces: np.ndarray, bytes_: np.ndarray):
        self.names, self.pieces, self.bytes = names, pieces, bytes_

    @staticmethod
    def of(names: list[str], piece_mass: np.ndarray, byte_mass: np.ndarray) -> Weights:
        total = piece_mass.sum(0) + byte_mass.sum(0)
        with np.errstate(divide="ignore"):
            return Weights(names, np.log(piece_mass / total), np.log(byte_mass / total))


def code_points(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


class Lattice:
    """Forward (and backward) recursion over many words of one length at once.

    Words whose spelling in bytes is likelier than exp(``LEAST``) are summed as
    plain probabilities, which cannot run out of range then; all others as
    logarithms."""

    LEAST = -600.0
    _MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(44)

    def __init__(self, weights: Weights):
        self.w = weights
        self.plain = np.exp(weights.pieces)
        self.first = weights.pieces[weights.names.index(MARK)] if MARK in weights.names else -np.inf
        hashes = np.zeros(len(weights.names), np.uint64)
        sizes = np.array([len(p) for p in weights.names])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            hashes[at] = self._hash(code_points([weights.names[i] for i in at], int(n)))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.lengths = sorted(set(sizes.tolist()))
        self.strata = weights.pieces.shape[1]
        self.maybe = np.zeros(1 << 20, bool)  # what is no piece is seldom searched for
        self.maybe[self._slot(hashes)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                h = h * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * self._MIX) >> self._SHIFT

    def _spans(self, codes: np.ndarray):
        """(start, end, rows, piece numbers) of every piece that fits, by end."""
        m, n = codes.shape
        with np.errstate(over="ignore"):
            heads, power = [np.zeros(m, np.uint64)], [np.uint64(1)]
            for i in range(n):
                heads.append(heads[-1] * BASE + codes[:, i].astype(np.uint64) + np.uint64(1))
                power.append(power[-1] * BASE)
            for j in range(1, n + 1):
                for size in self.lengths:
                    if size > j:
                        break
                    h = heads[j] - heads[j - size] * power[size]
                    rows = np.flatnonzero(self.maybe[self._slot(h)])
                    if not len(rows):
                        continue
                    h = h[rows]
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    good = self.hashes[at] == h
                    if good.any():
                        yield j - size, j, rows[good], self.order[at[good]]

    def _parts(self, words: list[bytes]):
        """(places, codes, characters, their numbers, log-probabilities of spelling
        them in bytes by (row, place, stratum), whether plain numbers will do) of
        equally long words."""
        for n, places, text in by_length(words):
            step = 4096 if n <= LONG else 1
            for a in range(0, len(places), step):
                codes = code_points(text[a : a + step], n)
                chars, back = np.unique(codes, return_inverse=True)
                per = np.array([self.w.bytes[list(chr(int(c)).encode("utf-8", "replace"))].sum(0) for c in chars])
                back = back.reshape(codes.shape)
                spelled = per[back]
                plain = (spelled[:, 1:].sum(1) + self.first > self.LEAST).all(1)
                for linear in (True, False):
                    rows = np.flatnonzero(plain == linear)
                    if len(rows) == len(codes):
                        yield places[a : a + step], codes, chars, back, spelled, linear
                    elif len(rows):
                        yield places[a : a + step][rows], codes[rows], chars, back[rows], spelled[rows], linear

    def _forward(self, codes: np.ndarray, spans: list, spelled: np.ndarray, linear: bool) -> list[np.ndarray]:
        m, n = codes.shape
        add, times, pieces = (np.add, np.multiply, self.plain) if linear else (np.logaddexp, np.add, self.w.pieces)
        alpha = [np.full((m, self.strata), 1.0 if linear else 0.0), *[np.full((m, self.strata), 0.0 if linear else -np.inf) for _ in range(n)]]
        at = 0
        for j in range(1, n + 1):
            if j > 1:
                alpha[j] = times(alpha[j - 1], spelled[:, j - 1])
            while at < len(spans) and spans[at][1] == j:
                i, _, rows, piece = spans[at]
                alpha[j][rows] = add(alpha[j].take(rows, 0), times(alpha[i].take(rows, 0), pieces.take(piece, 0)))
                at += 1
        return alpha

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal over all segmentations: (word, stratum)."""
        out = np.empty((len(words), self.strata))
        for places, codes, _, _, spelled, linear in self._parts(words):
            last = self._forward(codes, list(self._spans(codes)), np.exp(spelled) if linear else spelled, linear)[-1]
            out[places] = np.log(last) if linear else last
        return out

    def expect(self, words: list[bytes], mass: np.ndarray, pieces: np.ndarray, bytes_: np.ndarray) -> None:
        """Add the expected uses of pieces and bytes; ``mass`` (word, stratum)
        says how often each word counts."""
        for places, codes, chars, back, spelled, linear in self._parts(words):
            m, n = codes.shape
            spans = list(self._spans(codes))
            if linear:
                spelled = np.exp(spelled)
            add, times, own = (np.add, np.multiply, self.plain) if linear else (np.logaddexp, np.add, self.w.pieces)
            alpha = self._forward(codes, spans, spelled, linear)
            beta = [np.full((m, self.strata), 0.0 if linear else -np.inf) for _ in range(n)]
            with np.errstate(divide="ignore"):  # from here on each word has its mass
                beta.append(mass[places] / alpha[n] if linear else np.log(mass[places]) - alpha[n])
            uses, post = [], np.zeros((m, n, self.strata))
            at = len(spans) - 1
            for j in range(n, 0, -1):
                while at >= 0 and spans[at][1] == j:
                    i, _, rows, piece = spans[at]
                    x = times(own.take(piece, 0), beta[j].take(rows, 0))
                    uses.append((piece, times(alpha[i].take(rows, 0), x)))
                    beta[i][rows] = add(beta[i].take(rows, 0), x)
                    at -= 1
                if j > 1:
                    x = times(spelled[:, j - 1], beta[j])
                    share = times(alpha[j - 1], x)
                    post[:, j - 1] = share if linear else np.exp(share)
                    beta[j - 1] = add(beta[j - 1], x)
            piece = np.concatenate([p for p, _ in uses]) if uses else np.zeros(0, np.int64)
            share = np.concatenate([x for _, x in uses]) if uses else np.zeros((0, self.strata))
            if not linear:
                share = np.exp(share)
            which, slot = np.unique(piece, return_inverse=True) if m == 1 else (slice(None), piece)
            length = len(which) if m == 1 else len(pieces)
            spelt = np.empty((len(chars), self.strata))
            for k in range(self.strata):
                pieces[which, k] += np.bincount(slot, share[:, k], length)
                spelt[:, k] = np.bincount(back.ravel(), post[:, :, k].ravel(), len(chars))
            for c, x in zip(chars, spelt, strict=True):
                if x.max() > 1e-9:
                    np.add.at(bytes_, list(chr(int(c)).encode("utf-8", "replace")), x)


def by_length(words: list[bytes]):
    """(length, places, marked words) for groups of equally long words."""
    text = [MARK + w.decode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    order = np.argsort(sizes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        yield int(sizes[places[0]]), places, [text[i] for i in places.tolist()]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and starting weights of an existing ``sentencepiece`` vocabulary:
    ordinary pieces by rank (score r, weight 1 / (2.7 - r))."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = {
        sp.id_to_piece(i): 1 / (2.7 - sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8
    }
    raw.setdefault(MARK, min(raw.values(), default=1.0))
    return list(raw), np.array(list(raw.values())) / sum(raw.values())


# --------------------------------------------------------------- Spark stages

def regroup(batches, rows: int = 100_000):
    """Larger record batches from small ones, so that words of one length come
    in numbers worth a vector."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_counts(texts: DataFrame, strata: int, limit: int = 300_000) -> DataFrame:
    """(word binary, n long, c0.. long) over columns ``raw`` (binary) and
    ``stratum``; the end mark is the empty word.  Each task keeps at most about
    ``limit`` distinct words at a time."""

    def run(batches):
        seen = [Counter() for _ in range(strata)]
        for b in batches:
            for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[k].update(tokens(raw))
                seen[k][b""] += 1
                if sum(map(len, seen)) > limit:
                    yield flush(seen)
        yield flush(seen)

    def flush(seen):
        out = pa.RecordBatch.from_arrays([
            pa.array([w for s in seen for w in s], pa.binary()),
            pa.array([k for k, s in enumerate(seen) for _ in s], pa.int32()),
            pa.array([n for s in seen for n in s.values()], pa.int64())], names=["word", "k", "n"])
        for s in seen:
            s.clear()
        return out

    got = texts.select("raw", "stratum").mapInArrow(run, "word binary, k int, n long")
    sums = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(strata)]
    return got.groupBy("word").agg(F.sum("n").alias("n"), *sums)


def fit_lattice(words: DataFrame, path: str, strata: int, rounds: int, prior: float = 50.0) -> Weights:
    """Forward-backward rounds over distinct words, each weighing log2(1 + c_k)
    in stratum k.  What is collected has one row per vocabulary piece."""
    names, start = vocabulary(path)
    first = np.repeat(start[:, None], strata, 1)
    model = Weights.of(names, first * 0.999, np.full((256, strata), 0.001 / 256))
    columns = [f"u{k}" for k in range(strata)]
    for _ in range(rounds):
        def run(batches, model=model):
            lattice = Lattice(model)
            pieces, bytes_ = np.zeros((len(names), strata)), np.zeros((256, strata))
            for b in regroup(batches):
                mass = np.log2(1 + np.column_stack([b.column(1 + k).to_numpy() for k in range(strata)]))
                lattice.expect(b.column(0).to_pylist(), mass, pieces, bytes_)
            uses = np.concatenate([pieces, bytes_])
            live = np.flatnonzero(uses.max(1) > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), *[pa.array(uses[live, k], pa.float64()) for k in range(strata)]], names=["i", *columns])

        parts = words.where(F.octet_length("word") > 0).select("word", *[f"c{k}" for k in range(strata)])
        got = parts.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        uses = np.zeros((len(names) + 256, strata))
        uses[got["i"].to_numpy(np.int64)] = got[columns].to_numpy()
        model = Weights.of(names, uses[:-256] + prior * first, uses[-256:] + prior / 256)
    return model


class Scorer:
    """log10 probabilities of words under the base and under each stratum."""

    def __init__(self, weights: Weights, total: int, distinct: int, sizes: np.ndarray):
        """``sizes``: rows N_k, V_k, D_k."""
        self.lattice, self.total, self.distinct = Lattice(weights), total, distinct
        self.n, self.v, self.d = sizes

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def score(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """(word, stratum); counts (word, stratum)."""
        back = np.full((len(words), len(self.n)), math.log(END_SHARE))
        real = np.array([i for i, w in enumerate(words) if w], np.int64)
        if len(real):
            back[real] = math.log(1 - END_SHARE) + self.lattice.log_probs([words[i] for i in real])
        with np.errstate(divide="ignore", invalid="ignore"):
            unseen = np.where(self.n > 0, np.log(self.d * self.v / self.n), 0.0) + back
            own = np.where((self.n > 0) & (counts > self.d), np.log((counts - self.d) / self.n), -np.inf)
        return np.logaddexp(own, unseen) / LN10


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def stratum_numbers(rows: DataFrame, most: int) -> tuple[list, bool]:
    """The ``most`` commonest values of column ``label`` in training rows, and
    whether other values or null occur, which form one further stratum."""
    counts = rows.where(~F.col("held_out")).groupBy("label").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    got = counts.where("label is not null").orderBy(F.desc("count"), "label").limit(most).collect()
    return [r["label"] for r in got], total > sum(r["count"] for r in got)


def frequency_floor(counts: DataFrame, most: int) -> int:
    """Lowest step of log2(n) * 16 from which on at most ``most`` words lie; a
    histogram of about a thousand steps decides, no global order is needed."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("k")).collect()
    total = 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["k"]
        if total > most:
            return r["step"] + 1
    return 0


def score_texts(docs: DataFrame, held_out: Column, vocabulary_path: str, strata_col: str | None = None, max_strata: int = 6,
                rounds: int = 2, hot_words: int = 1 << 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row of ``docs`` (doc_id, text), learnt from the rows that are not
    held out.

    ``strata_col`` names a column whose values group the training texts; it is
    not read for the texts that are scored.  Null and empty texts consist of
    the end mark alone.  Repeated rows give repeated results; rows that share
    an id but not the text are kept apart.  Without training rows all counts
    are 0 and the lattice alone scores.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    label = F.col(strata_col).cast("string") if strata_col else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), held_out.alias("held_out"), text.cast("binary").alias("raw"), label.alias("label"))
    labels, others = stratum_numbers(rows, max_strata) if strata_col else ([], True)
    strata = len(labels) + (others or not labels)
    number = F.lit(strata - 1)
    for k, value in enumerate(labels):
        number = F.when(F.col("label") == value, k).otherwise(number)
    rows = rows.withColumn("stratum", F.coalesce(number, F.lit(strata - 1)).cast("int"))
    cs = [f"c{k}" for k in range(strata)]
    counts = cut(word_counts(rows.where(~F.col("held_out")), strata))
    s = counts.agg(
        F.sum("n"), F.count("*"),
        *[F.sum(c) for c in cs], *[F.count_if(F.col(c) > 0) for c in cs], *[F.count_if(F.col(c) == 1) for c in cs], *[F.count_if(F.col(c) == 2) for c in cs],
        *[F.sum(F.when(F.octet_length("word") == 0, F.col(c))) for c in cs],
    ).first()
    total, distinct = int(s[0] or 0), int(s[1])
    n, v, n1, n2, ends = np.array([x or 0 for x in s[2:]], float).reshape(5, strata)
    sizes = np.stack([n, v, np.clip(n1 / np.maximum(1, n1 + 2 * n2), 0.05, 0.95)])
    shares = (ends + 0.5 / strata) / (ends.sum() + 0.5)
    weights = fit_lattice(counts, vocabulary_path, strata, rounds)
    ss = [f"s{k}" for k in range(strata)]
    doubles = ", ".join(f"{c} double" for c in ss)
    model = docs.sparkSession.sparkContext.broadcast((weights, total, distinct, sizes))

    def rate(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            words = b.column(0).to_pylist()
            got = scorer.score(words, np.column_stack([b.column(1 + i).to_numpy() for i in range(1, strata + 1)]))
            base = scorer.base(b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base), *[pa.array(got[:, k]) for k in range(strata)]], names=["word", "base", *ss])

    top = counts.where(F.floor(F.log2("n") * 16) >= frequency_floor(counts, hot_words))
    table = top.repartition(32, "word").mapInArrow(rate, f"word binary, base double, {doubles}").toArrow()
    hot = docs.sparkSession.sparkContext.broadcast((
        {w: i for i, w in enumerate(table.column("word").to_pylist())},
        np.column_stack([table.column(c).to_numpy() for c in ["base", *ss]]),
    ))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sums = f"copies long, n_tokens long, n_known long, base double, {doubles}"

    def first_pass(batches):
        known, scores = hot.value
        for b in batches:
            word, m, sizes, n_tokens, n_known, sums_ = [], [], [], [], [], []
            hs = b.column(1).to_pylist()
            for i, raw in enumerate(b.column(3).to_pylist()):
                ts = tokens(raw)
                ts.append(b"")
                found = np.fromiter(map(known.get, ts, repeat(-1)), np.int64, len(ts))
                rare = Counter([ts[j] for j in np.flatnonzero(found < 0).tolist()])
                found = found[found >= 0]
                # the row that carries a document's sums gets a key of its own: words hold no
                # space, so it matches none, and these rows spread evenly over the join
                word.append(b" %d %d %d" % (hs[i], i, len(ts)))
                word += rare
                m.append(0)
                m += rare.values()
                sizes.append(1 + len(rare))
                n_tokens.append(len(ts))
                n_known.append(len(found))
                sums_.append(scores.take(found, 0).sum(0))
            heads = np.cumsum([0, *sizes])[:-1]
            take, m_ = pa.array(np.repeat(np.arange(len(sizes)), sizes)), np.array(m, np.int64)
            whole, block = np.zeros((2, len(m)), np.int64), np.zeros((strata + 1, len(m)))
            if len(m):
                whole[:, heads], block[:, heads] = [n_tokens, n_known], np.array(sums_).T
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(3)), pa.array(word, pa.binary()), pa.array(m_), pa.array((m_ == 0).astype(np.int64)),
                 *map(pa.array, whole), *map(pa.array, block)],
                names=["doc_id", "h", "held_out", "word", "m", "copies", "n_tokens", "n_known", "base", *ss])

    def second_pass(batches):
        scorer = Scorer(*model.value)
        for b in regroup(batches, 60_000):
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            m = col["m"].to_numpy()
            live = np.flatnonzero(m > 0)
            known = col["n_known"].to_numpy().copy()
            block = np.column_stack([col[c].to_numpy() for c in ["base", *ss]])
            if len(live):
                words = col["word"].take(pa.array(live)).to_pylist()
                whole = np.nan_to_num(col["n"].to_numpy(zero_copy_only=False)[live].astype(float))
                own = np.nan_to_num(np.column_stack([col[c].to_numpy(zero_copy_only=False)[live].astype(float) for c in cs]))
                # equal words follow each other after the sort of the join
                change = np.array([True, *[x != y for x, y in zip(words[1:], words)]])
                one, back = np.flatnonzero(change), np.cumsum(change) - 1
                rated = np.column_stack([scorer.base(whole[one]), scorer.score([words[i] for i in one], own[one])])
                block[live] = rated[back] * m[live][:, None]
                known[live] = np.where(whole > 0, m[live], 0)
            yield pa.RecordBatch.from_arrays(
                [*(col[c] for c in ("doc_id", "h", "held_out", "copies", "n_tokens")), pa.array(known), *[pa.array(block[:, k]) for k in range(strata + 1)]],
                names=["doc_id", "h", "held_out", "copies", "n_tokens", "n_known", "base", *ss])

    key = f"doc_id {id_type}, h long, held_out boolean"
    spread = rows.select("doc_id", "h", "held_out", "raw").mapInArrow(first_pass, f"{key}, word binary, m long, {sums}").join(counts, "word", "left")
    done = spread.mapInArrow(second_pass, f"{key}, {sums}").groupBy("doc_id", "h", "held_out").agg(*[F.sum(c).alias(c) for c in ["copies", "n_tokens", "n_known", "base", *ss]])
    each = {c: F.col(c) / F.col("copies") for c in ["n_tokens", "n_known", "base", *ss]}
    terms = F.array(*[each[c] + float(np.log10(p)) for c, p in zip(ss, shares, strict=True)])
    best = F.array_max("terms")
    mixed = best + F.log10(F.aggregate(F.transform("terms", lambda t: F.pow(F.lit(10.0), t - best)), F.lit(0.0), lambda a, x: a + x))
    return done.withColumn("terms", terms).select(
        "doc_id", "held_out",
        each["n_tokens"].cast("long").alias("n_tokens"), each["n_known"].cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        each["base"].alias("base_score"), mixed.alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).drop("_copy")


def op1_lattice_lm(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """All documents; those with crc32(doc_id) mod 5 = 1 are held out.  The
    training texts are grouped by language."""
    return score_texts(docs, in_fold(F.col("doc_id"), 5, 1), vocabulary_path, "lang" if "lang" in docs.columns else None)
