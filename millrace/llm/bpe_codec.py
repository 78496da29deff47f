"""Byte-level BPE encoding and decoding (operator 5).

Texts of at most ``stride`` characters are encoded in place.  Longer ones are
cut into chunks of ``stride`` characters that overlap by ``overlap``; chunks
are dealt over the cluster and pre-tokenised in parallel.  The pre-token
starts that a chunk and its right neighbour both find inside their overlap are
joined natively; the first common one is the seam, because from a true
pre-token start the pattern sees only what follows and so gives the same
pieces in both.  The pieces between two seams are then encoded by rank.
Decoding looks every id up and concatenates raw bytes.

A text with a seam that never resynchronises (one unbroken run longer than the
overlap) is encoded unsplit.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import parts
from millrace.llm.pretok import PATTERN, PRETOKEN, Memo, boundaries, segments
from millrace.runtime import cut, default_parallelism, ship

STRIDE, OVERLAP = 32_768, 2_048


class Codec:
    """Encodes segments by rank and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.raw: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self.words = Memo(lambda w: self._remember(" " + w))

    def pieces(self, text: str) -> list[int]:
        """Ids of a text, each pre-token encoded by itself."""
        one = self.core.encode_single_piece
        return [i for p in PRETOKEN.findall(text) for i in one(p.encode("utf-8"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def _remember(self, text: str) -> tuple[int, str, bytes]:
        ids = self.pieces(text)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def run(self, text: str) -> tuple[int, str, bytes]:
        """Count, ids joined by one space, decoded bytes."""
        if not text:
            return 0, "", b""
        first, *rest = segments(text)
        got = [self._remember(first), *map(self.words.__getitem__, rest)]
        counts, ids, raw = zip(*got, strict=True)
        return sum(counts), " ".join(ids), b"".join(raw)


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    """Read a rank file once per worker process."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _append(batch: pa.RecordBatch, arrays: list[pa.Array], names: list[str], drop: str) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=[*(batch.schema.names[i] for i in keep), *names])


def _encode_rows(df: DataFrame, ranks_path: str, digests: bool) -> DataFrame:
    """Replace ``text`` by n_tokens and ids/bytes, or by their digests."""

    def run(batches):
        codec = load_codec(ranks_path)
        for b in parts(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            counts, ids, raws = [], [], []
            for t in texts:
                n, i, r = codec.run(t or "")
                counts.append(n)
                ids.append(hashlib.sha256(i.encode()).hexdigest() if digests else i)
                raws.append(hashlib.sha256(r).hexdigest() if digests else r)
            kinds = (pa.string(), pa.string()) if digests else (pa.string(), pa.binary())
            yield _append(b, [pa.array(counts, pa.int64()), pa.array(ids, kinds[0]), pa.array(raws, kinds[1])], _OUT[digests], "text")

    schema = type(df.schema)([f for f in df.schema if f.name != "text"]).add("n_tokens", "long")
    schema = schema.add(_OUT[digests][1], "string").add(_OUT[digests][2], "string" if digests else "binary")
    return df.mapInArrow(run, schema)


_OUT = {True: ["n_tokens", "ids_sha256", "decoded_sha256"], False: ["n_tokens", "ids", "decoded"]}


def _chunks(df: DataFrame, stride: int, overlap: int) -> DataFrame:
    """One row per chunk: text from k * stride, ``stride + overlap`` characters."""
    last = F.greatest(F.ceil(F.length("text") / stride).cast("int") - 1, F.lit(0))
    return df.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_k")).withColumn(
        "text", F.substring("text", F.col("_k") * stride + 1, F.lit(stride + overlap))
    )


def _seam_candidates(chunks: DataFrame, stride: int, overlap: int) -> DataFrame:
    """Per chunk the pre-token starts inside its left and right overlap,
    counted from the start of the overlap."""

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            left, right = [], []
            for t in texts:
                left.append([p for p in boundaries(t[: overlap + 64]) if 0 < p < overlap])
                at = boundaries(t) if len(t) > stride else []
                # a contraction cut by the chunk's end shows up to two characters too early; and white
                # space before a seam would be split otherwise once nothing follows it
                right.append([p - stride for p in at if stride < p <= len(t) - 3 and not t[p - 1].isspace()])
            kind = pa.list_(pa.int32())
            yield _append(b, [pa.array(left, kind), pa.array(right, kind)], ["_left", "_right"], "text")

    schema = type(chunks.schema)([f for f in chunks.schema if f.name != "text"]).add("_left", T.ArrayType(T.IntegerType())).add("_right", T.ArrayType(T.IntegerType()))
    return chunks.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, ranks_path: str, digests: bool = True, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """Replace ``text`` by token count, ids and decoded bytes (or digests).

    Columns: those of ``docs`` but ``text``, then n_tokens and
    ids_sha256/decoded_sha256 (lower-case hex) with ``digests``, else ids (decimal,
    joined by one space) and decoded (binary).  Null texts are empty texts: 0
    tokens.  Repeated rows give repeated results; clashing column names
    (n_tokens, ids, decoded, ...) are replaced.  Ids and bytes of a long text
    meet again in one row, as the text itself did.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids", "decoded", *_OUT[True], "_row", "_k")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    short = _encode_rows(docs.where(F.length("text") <= stride), ranks_path, digests)
    long = docs.where(F.length("text") > stride).withColumn("_row", F.monotonically_increasing_id())
    long = cut(long)  # row numbers must not change when a task is repeated
    if long.isEmpty():
        return short
    return short.unionByName(_encode_long(long, ranks_path, digests, stride, overlap))


def _encode_long(long: DataFrame, ranks_path: str, digests: bool, stride: int, overlap: int) -> DataFrame:
    others = [c for c in long.columns if c not in ("text", "_row")]
    n = default_parallelism(long.sparkSession)
    chunks = _chunks(long.select("_row", "text"), stride, overlap).repartition(n, "_row", "_k")
    marks = cut(_seam_candidates(chunks, stride, overlap))
    right = marks.select("_row", F.col("_k").alias("_k"), "_right")
    left = marks.where("_k > 0").select("_row", (F.col("_k") - 1).alias("_k"), "_left")
    seams = right.join(left, ["_row", "_k"]).select("_row", "_k", F.array_min(F.array_intersect("_right", "_left")).alias("_seam"))
    unsplit = seams.where("_seam is null").select("_row").distinct()
    ends = seams.select("_row", "_k", (F.col("_seam") + stride).alias("_end"))
    starts = seams.select("_row", (F.col("_k") + 1).alias("_k"), F.col("_seam").alias("_start"))
    pieces = (
        chunks.join(unsplit, "_row", "left_anti").join(ends, ["_row", "_k"], "left").join(starts, ["_row", "_k"], "left")
        .withColumn("_start", F.coalesce("_start", F.lit(0)))
        .withColumn("text", F.expr("substring(text, _start + 1, coalesce(_end, length(text)) - _start)"))
        .drop("_start", "_end")
    )
    whole = long.join(unsplit, "_row").select("_row", F.lit(0).alias("_k"), "text")
    encoded = _encode_rows(pieces.select("_row", "_k", "text").unionByName(whole), ranks_path, digests=False)
    ordered = F.array_sort(F.collect_list(F.struct("_k", "n_tokens", "ids", F.hex("decoded").alias("hex"))))
    got = encoded.groupBy("_row").agg(ordered.alias("p"))
    ids = F.array_join(F.filter(F.col("p.ids"), lambda x: x != ""), " ")
    raw = F.unhex(F.array_join("p.hex", ""))
    total = F.aggregate("p.n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    out = got.select(
        "_row", total.alias("n_tokens"),
        (F.sha2(ids, 256) if digests else ids).alias(_OUT[digests][1]),
        (F.sha2(raw, 256) if digests else raw).alias(_OUT[digests][2]),
    )
    return long.drop("text").join(out, "_row").select(*others, *_OUT[digests])


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids (array<int>) and
    round_trip, whether the decoded bytes are the text's bytes."""
    given = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    got = encode_decode(given, ranks_path, digests=False)
    ids = F.when(F.col("ids") == "", F.expr("cast(array() as array<int>)")).otherwise(F.split("ids", " ").cast("array<int>"))
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    return got.select(*kept, "n_tokens", ids.alias("ids"), (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))


def op5_encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_decode(docs.select("doc_id", "text"), ranks_path)
