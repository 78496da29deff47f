"""Exact top-k search by term-at-a-time accumulation (operator 3).

Every vector component is a term.  Queries are grouped into blocks, candidates
into shards; a block and a shard meet in one group.  There the shard becomes
posting lists (dimension -> row numbers, weights); for each query and each of
its non-zero dimensions the weighted postings are scattered into a dense score
array, from which a partition selection keeps k rows.  The partial winners of
all shards are merged per query with a window over k rows per shard.

All work for a group is bounded by ``query_block`` x ``shard_rows``.  The
number of score evaluations is queries x candidates by definition; candidates
are copied once per query block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.runtime import ship


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, w array<long>): floor(scale * x), x as double.  Rows with a null
    id, a null vector, or a null or non-finite component are left out."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("w"))
    )


def postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (row numbers, weights), zero weights left out."""
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    if not lengths.sum():
        return {}
    row = np.repeat(np.arange(len(rows)), lengths)
    dim = np.concatenate([np.arange(n) for n in lengths])
    weight = np.concatenate(rows).astype(np.int64)
    live = weight != 0
    row, dim, weight = row[live], dim[live], weight[live]
    order = np.argsort(dim, kind="stable")
    row, dim, weight = row[order], dim[order], weight[order]
    dims, at = np.unique(dim, return_index=True)
    ends = [*at[1:], len(dim)]
    return {int(d): (row[a:b], weight[a:b]) for d, a, b in zip(dims, at, ends, strict=True)}


def select_top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score descending, smaller id on ties."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        pos = np.flatnonzero(score >= floor)
    else:
        pos = np.arange(len(score))
    return pos[np.lexsort((ids[pos], -score[pos]))[:k]]


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = 1024, query_block: int = 512, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best.

    ``is_query`` is a condition over vec_id.  A query's own row is the one with
    its id; repeated rows of an id are one candidate each, a query id that
    repeats is searched once (with its smallest vector).  Queries without any
    other row give nothing.  Ties go to the smaller vec_id.  Inner products are
    64-bit integers; vectors of unequal length meet in their common dimensions.
    """
    ship(vectors.sparkSession)
    base = quantise(vectors, id_col, vec_col, scale)
    queries = base.where(is_query).groupBy("vec_id").agg(F.min("w").alias("w"))
    sizes = base.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, shards = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // shard_rows))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks).cast("long")))
    q = q.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "w")
    # repeated rows of one id are spread as well: the shard is drawn from the row's place
    c = base.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    c = c.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "shard", "vec_id", "w")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = {"query_id": [], "vec_id": [], "score": []}
        if left.empty or right.empty:
            return pd.DataFrame(empty).astype("int64")
        ids = right.vec_id.to_numpy(np.int64)
        lists = postings([np.asarray(w, np.int64) for w in right.w])
        out = []
        for query_id, w in zip(left.vec_id.to_numpy(np.int64), left.w, strict=True):
            total = np.zeros(len(ids), np.int64)
            for dim, weight in enumerate(w):
                if weight and dim in lists:
                    rows, values = lists[dim]
                    total[rows] += weight * values
            other = np.flatnonzero(ids != query_id)
            pos = other[select_top(total[other], ids[other], k)]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[pos], "score": total[pos]}))
        return pd.concat(out, ignore_index=True).astype("int64")

    found = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInPandas(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(embeddings: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against every other row, 10 best."""
    return search(embeddings, F.col("vec_id") % 100 == 0, k=10)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
