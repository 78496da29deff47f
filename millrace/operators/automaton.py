"""Many strings looked for at once, in one pass over each text.

The strings are an Aho-Corasick automaton.  They reach tasks as broadcast parts
of bounded size: a part holds at most ``limit`` characters, and texts are read
once per part, so that neither a task nor a broadcast grows with the list.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.runtime import cut, ship

LIMIT = 4_000_000  # characters of one part
ROWS = 1024


def build(strings: list[str]):
    """Automaton whose hits are (end, number of the string)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        if s:
            out.add_word(s, (i, len(s)))
    out.make_automaton()
    return out


def hits(machine, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, number) of every place of every string, by end."""
    if len(machine):
        for last, (i, n) in machine.iter(text):
            yield last + 1 - n, last + 1, i


class Flat:
    """A text with every gap (a pattern) written as one space, and the way back."""

    def __init__(self, text: str, gap: re.Pattern):
        parts, self.starts, self.flat_starts, at, size = [], [0], [0], 0, 0
        for m in gap.finditer(text):  # where the text goes on after a gap, in it and in the flat one
            parts += [text[at : m.start()], " "]
            size += m.start() - at + 1
            at = m.end()
            self.starts.append(at)
            self.flat_starts.append(size)
        self.text = "".join([*parts, text[at:]])

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """Where a part of the flat text that begins and ends outside gaps stands."""
        k, j = bisect_right(self.flat_starts, start) - 1, bisect_right(self.flat_starts, stop - 1) - 1
        return self.starts[k] + start - self.flat_starts[k], self.starts[j] + stop - self.flat_starts[j]


def lowered(text: str) -> str:
    """Lower case, character by character: places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def numbered(list_: DataFrame, size: str, limit: int) -> list[DataFrame]:
    """``list_`` in parts whose ``size`` adds up to ``limit`` at most (or one row)."""
    total = list_.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        return [list_] if total else []
    share = -(-2 * total // limit)
    spread = cut(list_.withColumn("_share", F.pmod(F.xxhash64(*list_.columns), F.lit(share))))
    upto = Window.partitionBy("_share").orderBy(*list_.columns).rowsBetween(Window.unboundedPreceding, 0)
    spread = cut(spread.withColumn("_part", F.floor((F.sum(size).over(upto) - F.col(size)) / limit)))
    return [spread.where((F.col("_share") == s) & (F.col("_part") == p)).select(*list_.columns) for s, p in sorted(tuple(r) for r in spread.select("_share", "_part").distinct().collect())]


def search(texts: DataFrame, list_: DataFrame, size: str, find: Callable[[list[dict]], Callable[[str], list]], result: str, limit: int = LIMIT) -> DataFrame:
    """``texts`` (key columns, then the text) with what ``find`` returns for each
    text, as a list of structs in column ``found`` (DDL ``result``) in place of
    the text: a row per text and part of the list.  ``find`` gets a part's rows
    and makes the function for texts, once per task."""
    spark = texts.sparkSession
    ship(spark)
    keys = texts.columns[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]), f"found array<struct<{result}>>"])

    def over(part: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(part.toArrow().to_pylist())

        def run(batches):
            look = None
            for b in batches:
                look = look or find(sent.value)
                for at in range(0, b.num_rows, ROWS):
                    some = b.slice(at, ROWS)
                    found = pa.array([look(t or "") for t in some.column(len(keys)).to_pylist()], kind)
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], found], names=[*keys, "found"])

        return texts.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(f"array<struct<{result}>>"))
    parts = numbered(list_, size, limit)
    if not parts:
        return texts.select(*keys, F.expr(f"cast(array() as array<struct<{result}>>)").alias("found"))
    return reduce(DataFrame.unionByName, [over(p) for p in parts])


def with_found(rows: DataFrame, text: str, list_: DataFrame, size: str, find: Callable[[list[dict]], Callable[[str], list]], result: str, limit: int = LIMIT) -> DataFrame:
    """``rows`` with all that ``search`` finds in a column, in one array ``_found``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    if (list_.agg(F.sum(size)).first()[0] or 0) <= limit:
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
        return search(rows.select(whole, body), list_, size, find, result, limit).select("_row.*", F.col("found").alias("_found"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = search(rows.select("_row", body), list_, size, find, result, limit).groupBy("_row").agg(F.flatten(F.collect_list("found")).alias("_found"))
    return rows.join(found.hint("merge"), "_row").drop("_row")
