"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

A pre-token starts as its bytes in a doubly linked list.  A heap holds the
adjacent pairs that have a merge rank; the lowest rank (leftmost on ties) is
popped, stale entries are skipped, the two nodes become one and the new
neighbours are pushed.  The count is the number of bytes minus the number of
merges; no identifiers are produced.

Only the partition's current Arrow batch and a bounded word memo are held in
memory.  There is no shuffle.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.pretok import PRETOKEN, Memo, segments
from millrace.runtime import ship


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    printable Latin-1 letters stand for themselves, the rest follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class MergeCounter:
    """Counts the tokens of texts under a merge list."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        letters = byte_letters()
        self.ids: dict[str, int] = {c: i for i, c in enumerate(letters)}
        for left, right in merges:
            self.ids.setdefault(left + right, len(self.ids))
        self.byte_ids = [self.ids[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.pairs[(self.ids[left], self.ids[right])] = (rank, self.ids[left + right])
        self.specials = [s for s in specials if s]
        self.pieces = Memo(lambda p: self.merged(p.encode("utf-8")))
        self.words = Memo(lambda w: self.segment(" " + w))

    def merged(self, raw: bytes) -> int:
        """Symbols left after all merges of one pre-token."""
        n = len(raw)
        if n < 2:
            return n
        ids, pairs = [self.byte_ids[b] for b in raw], self.pairs
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*pairs[ab], i, *ab) for i in range(n - 1) if (ab := (ids[i], ids[i + 1])) in pairs]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, made, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            merges += 1
            if (k := after[i]) >= 0:
                before[k] = i
                if (ab := (made, ids[k])) in pairs:
                    heapq.heappush(heap, (*pairs[ab], i, *ab))
            if (h := before[i]) >= 0 and (ab := (ids[h], made)) in pairs:
                heapq.heappush(heap, (*pairs[ab], h, *ab))
        return n - merges

    def segment(self, text: str) -> int:
        pieces = self.pieces
        return sum([pieces[p] for p in PRETOKEN.findall(text)])

    def count(self, text: str) -> int:
        """Tokens of a text; special strings inside it count as one each,
        leftmost first, longer ones first at the same place."""
        if not text:
            return 0
        for s in self.specials:
            if s in text:
                return self._with_specials(text)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = segments(text)
        return self.segment(first) + sum(map(self.words.__getitem__, rest))

    def _with_specials(self, text: str) -> int:
        import re

        parts = re.split("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)), text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def load_counter(path: str) -> MergeCounter:
    """Read a ``tokenizers`` file once per worker process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return MergeCounter(merges, [t["content"] for t in spec.get("added_tokens", []) if t.get("special")])


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with a long column of token counts.

    Null texts count as empty (0 tokens); every other column passes through,
    an existing ``out_col`` is replaced.  Repeated rows stay repeated.
    ``tokenizer_path`` must be readable on the executors.
    """
    ship(docs.sparkSession)
    docs = docs.drop(out_col)

    def run(batches):
        counter = load_counter(tokenizer_path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            counts = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=[*b.schema.names, out_col])

    schema = T.StructType(list(docs.schema)).add(out_col, "long")
    return docs.mapInArrow(run, schema)


def op7_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(slim, tokenizer_path)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
