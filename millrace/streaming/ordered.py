"""Stateful work on events in order of time, with state in RocksDB.

Rows are taken as they come.  Each goes into the time slot of its key, in the
state store; when the watermark passes the end of a slot an event-time timer
fires, and the slot's rows are handled in order.  A task holds one frame of rows
or one slot, never a batch's rows of a key.  Rows of slots that have ended are
late: they are handed on as such and change nothing.  Where keys are many, a
share of them is handled at once (``Attempts``), since each call to the store is
a round trip to the JVM.

Rows of slots that have not ended when a stream stops stay in its state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.runtime import ship

ROW = np.dtype([("ts", "<i8"), ("id", "<i8"), ("ok", "?")])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000
# Bytes of a block and of a value in the state; rows of a frame; rows and bytes that are put into blocks at once.
BLOCK, PART, FRAME = 8192, 1 << 20, 100_000
HELD_ROWS, HELD_BYTES = 262_144, 1 << 25


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class InSlots(StatefulProcessor):
    """Keeps rows (ts, id, ok) by slot and hands each ended slot, in order of
    (ts, id), to ``handle``, with one number that lives as long as the key.

    State: rows by (slot, part), parts by slot, and the number, which is cleared
    by a timer ``idle`` ms after its last slot (None: never) if it is ``stale``."""

    def __init__(self, slot: int, idle: int | None = None):
        self.slot, self.idle = slot, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.rows = handle.getMapState("rows", "slot long, part long", "data binary")
        self.parts = handle.getMapState("parts", "slot long", "n long")
        self.number = handle.getValueState("number", "x long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[frame["at"].notna()]
            data = np.empty(len(frame), ROW)
            data["ts"] = frame["at"].to_numpy(np.int64)
            data["id"], data["ok"] = frame["id"].to_numpy(np.int64), frame["ok"].to_numpy(bool)
            ends = (data["ts"] // 1000 // self.slot + 1) * self.slot
            late = ends <= done
            if late.any():
                yield self.out(key, data[late], np.full(int(late.sum()), -1), True)
            data, ends = data[~late], ends[~late]
            for end in np.unique(ends).tolist():
                if self.parts.containsKey((end,)):
                    n = self.parts.getValue((end,))[0]
                else:
                    n = 0
                    self.timers.registerTimer(end)
                self.rows.updateValue((end, n), (data[ends == end].tobytes(),))
                self.parts.updateValue((end,), (n + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if not self.parts.containsKey((end,)):  # no slot ends here: an idle key's timer
            if self.number.exists() and self.stale(self.number.get()[0], end):
                self.number.clear()
            return
        n = self.parts.getValue((end,))[0]
        data = np.concatenate([np.frombuffer(self.rows.getValue((end, i))[0], ROW) for i in range(n)])
        for i in range(n):
            self.rows.removeKey((end, i))
        self.parts.removeKey((end,))
        data = data[np.lexsort((data["id"], data["ts"]))]
        number = self.number.get()[0] if self.number.exists() else None
        data, values, number = self.handle(data, number)
        if number is not None:
            self.number.update((number,))
        if self.idle is not None:  # slot ends are multiples of the slot, these timers are not
            self.timers.registerTimer(end + (self.idle // self.slot + 2) * self.slot + 1)
        if len(data):
            yield self.out(key, data, values, False)

    def handle(self, data: np.ndarray, number: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
        raise NotImplementedError

    def stale(self, number: int, now: int) -> bool:
        """Whether rows of slots that end after ``now`` (ms) do without the number."""
        return False

    @staticmethod
    def out(key, data: np.ndarray, values: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(data), "at": data["ts"], "id": data["id"], "n": values, "late": late})

    def close(self) -> None:
        pass


class Gate(InSlots):
    """Rows that come at least ``gap`` us after the last accepted one; the number
    is the time of that one."""

    def __init__(self, gap: int, slot: int):
        super().__init__(slot, idle=gap // 1000)
        self.gap = gap

    def handle(self, data, number):
        stamps, at, kept = data["ts"], 0, []
        if number is not None:
            at = int(np.searchsorted(stamps, number + self.gap))
        while at < len(stamps):
            kept.append(at)
            number = int(stamps[at])
            at = max(at + 1, int(np.searchsorted(stamps, number + self.gap)))
        return data[kept], np.zeros(len(kept), np.int64), number

    def stale(self, number, now):
        return (number + self.gap) // 1000 + self.slot < now


class Attempts(StatefulProcessor):
    """Failures in a row so far, after each row, for a share of the keys.

    Rows come in blocks of one slot, so that the state store is asked a few times
    per share and slot, not per key.  State: blocks by (slot, part), and one value
    with the parts of each slot that has not ended and the counts above 0 by key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.blocks = handle.getMapState("blocks", "slot long, part long", "data binary")
        self.held = handle.getValueState("held", "slots array<long>, parts array<long>, counts binary")

    def open_slots(self) -> tuple[dict[int, int], bytes | None]:
        slots, parts, counts = self.held.get() or ([], [], None)
        return dict(zip(map(int, slots), map(int, parts), strict=True)), counts

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        parts, counts = self.open_slots()
        for frame in rows:
            for end, blocks in frame.groupby("ends")["block"]:
                if end <= done:
                    for t in _tables(blocks):
                        yield self.out(t, np.full(len(t), -1), True)
                    continue
                if end not in parts:
                    self.timers.registerTimer(int(end))
                size = blocks.str.len().cumsum().to_numpy() // PART
                for some in np.split(blocks.to_numpy(), np.flatnonzero(np.diff(size)) + 1):
                    n = parts.get(end, 0)
                    self.blocks.updateValue((int(end), n), (b"".join(some),))
                    parts[int(end)] = n + 1
        self.held.update((list(parts), list(parts.values()), counts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        parts, counts = self.open_slots()
        n = parts.pop(end)
        rows = pa.concat_tables(_tables(self.blocks.getValue((end, i))[0] for i in range(n)))
        for i in range(n):
            self.blocks.removeKey((end, i))
        rows, values, counts = attempts_of(rows, counts)
        self.held.update((list(parts), list(parts.values()), counts))
        for i in range(0, len(rows), FRAME):
            yield self.out(rows.slice(i, FRAME), values[i : i + FRAME], False)

    @staticmethod
    def out(rows: pa.Table, values: np.ndarray, late: bool) -> pd.DataFrame:
        return rows.select(["key", "at", "id"]).to_pandas(integer_object_nulls=True).assign(n=values, late=late)

    def close(self) -> None:
        pass


def attempts_of(rows: pa.Table, counts: bytes | None) -> tuple[pa.Table, np.ndarray, bytes]:
    """``rows`` (key, at, id, ok) by key, in order of (at, id), the failures in a
    row after each, and the counts above 0 to go on with; ``counts``: those before."""
    before = pa.concat_tables(_tables([counts])) if counts else rows.select(["key"]).slice(0, 0).append_column("n", pa.array([], pa.int64()))
    found = pa.concat_tables([before.select(["key"]), rows.select(["key"])]).combine_chunks()["key"].combine_chunks().dictionary_encode("encode")
    code = found.indices.to_numpy()
    start = np.zeros(len(found.dictionary), np.int64)
    start[code[: len(before)]] = before["n"].to_numpy()
    code = code[len(before) :]
    order = np.lexsort((rows["id"].fill_null(np.iinfo(np.int64).min).to_numpy(), rows["at"].to_numpy(), code))
    rows, code = rows.take(order), code[order]
    place, last = np.arange(len(rows)), np.append(code[1:] != code[:-1], True)
    first = np.maximum.accumulate(np.where(np.append(True, last[:-1]), place, 0))
    reset = np.maximum.accumulate(np.where(rows["ok"].to_numpy(), place, -1))
    values = np.where(reset >= first, place - reset, place - first + 1 + start[code])
    start[code[last]] = values[last]
    after = np.flatnonzero(start)
    return rows, values, _block(pa.table({"key": found.dictionary.take(after), "n": start[after]}))


def _block(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _tables(blocks: Iterable[bytes]) -> Iterator[pa.Table]:
    """The tables of blocks, which may stand one after another in one value."""
    for data in blocks:
        source = pa.BufferReader(data)
        while source.tell() < len(data):
            yield pa.ipc.open_stream(source).read_all()


def _in_blocks(batches: list[pa.RecordBatch], slot: int) -> Iterator[pa.RecordBatch]:
    """Rows (share, key, at, id, ok) as (share, end of the slot, block)."""
    rows = pa.Table.from_batches(batches)
    share, ends = rows["share"].to_numpy(), (rows["at"].to_numpy() // 1000 // slot + 1) * slot
    order = np.lexsort((ends, share))
    share, ends, rows = share[order], ends[order], rows.drop_columns("share").take(order).combine_chunks()
    step = max(1, len(rows) * BLOCK // rows.nbytes)
    cuts = np.flatnonzero((np.diff(share) != 0) | (np.diff(ends) != 0)) + 1
    starts = [i for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) for i in range(a, b, step)]
    for some in (list(zip(starts, [*starts[1:], len(rows)], strict=True))[i : i + 1000] for i in range(0, len(starts), 1000)):
        at = [a for a, _ in some]
        yield pa.RecordBatch.from_arrays([pa.array(share[at]), pa.array(ends[at]), pa.array([_block(rows.slice(a, b - a)) for a, b in some], pa.binary())], names=["share", "ends", "block"])


def _run(events: DataFrame, key: str, id: str, ok, processor: StatefulProcessor, wait: str) -> DataFrame:
    """The stream of what ``processor`` makes of ``events`` (key, ts, id).

    The time is handed over in microseconds, without the watermark's mark, so that
    Spark leaves late rows to the processor.  Rows without a time are dropped."""
    ship(events.sparkSession)
    rows = events.withWatermark("ts", wait).select(F.col(key).alias("key"), F.unix_micros("ts").alias("at"), F.col(id).cast("long").alias("id"), ok.alias("ok"))
    kind = events.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, at long, id long, n long, late boolean", "append", "eventtime")
    return out.select("key", F.timestamp_micros("at").alias("ts"), "id", "n", "late")


def minimum_interval(events: DataFrame, key: str, id: str, minutes: int, wait: str = "1 hour", slot: int = 60 * MINUTE) -> DataFrame:
    """(key, ts, id, late): the accepted events of each key, and the late ones.

    An event is dropped if it comes less than ``minutes`` after the last accepted
    one; of equal times the smallest id counts.  Decided once the watermark
    (``wait`` behind the newest event) has passed a slot of ``slot`` ms."""
    return _run(events, key, id, F.lit(True), Gate(minutes * MINUTE * 1000, slot), wait).drop("n")


def attempts(events: DataFrame, key: str, id: str, success: str, limit: int = 3, wait: str = "1 hour", slot: int = 60 * MINUTE, shares: int = 256) -> DataFrame:
    """(key, ts, id, failed_attempts, final, late) per event in order of (ts,
    id); a success starts anew.  Late events have null counts.

    Keys are dealt to ``shares`` by hash; a task holds one slot of a share."""
    ship(events.sparkSession)
    rows = events.withWatermark("ts", wait).select(F.pmod(F.xxhash64(key), F.lit(shares)).alias("share"), F.col(key).alias("key"), F.unix_micros("ts").alias("at"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(success), F.lit(False)).alias("ok"))

    def run(batches):
        held = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= HELD_ROWS or sum(x.nbytes for x in held) >= HELD_BYTES:
                yield from _in_blocks(held, slot)
                held = []
        if held:
            yield from _in_blocks(held, slot)

    blocks = rows.where("at is not null").mapInArrow(run, "share long, ends long, block binary")
    kind = events.schema[key].dataType.simpleString()
    out = blocks.groupBy("share").transformWithStateInPandas(Attempts(), f"key {kind}, at long, id long, n long, late boolean", "append", "eventtime")
    n = F.when(~F.col("late"), F.col("n"))
    return out.select("key", F.timestamp_micros("at").alias("ts"), "id", n.alias("failed_attempts"), (n >= limit).alias("final"), "late")


class DayCounts(StatefulProcessor):
    """Events of a key per day; a day ends with the watermark, and what comes
    later is handed on row by row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.days = handle.getMapState("days", "day long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[frame["at"].notna()]
            ends = (frame["at"].to_numpy(np.int64) // 86_400_000_000 + 1) * 86_400_000
            late = ends <= done
            if late.any():
                yield pd.DataFrame({"key": [key[0]] * int(late.sum()), "day_end": ends[late], "id": frame["id"].to_numpy(np.int64)[late], "n": 1, "late": True})
            for end, n in zip(*(x.tolist() for x in np.unique(ends[~late], return_counts=True)), strict=True):
                if self.days.containsKey((end,)):
                    n += self.days.getValue((end,))[0]
                else:
                    self.timers.registerTimer(end)
                self.days.updateValue((end,), (n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        n = self.days.getValue((end,))[0]
        self.days.removeKey((end,))
        yield pd.DataFrame({"key": [key[0]], "day_end": [end], "id": pd.array([None], "Int64"), "n": [n], "late": [False]})

    def close(self) -> None:
        pass


def closed_days(events: DataFrame, source: str, id: str, wait: str = "1 day", shares: int = 8) -> DataFrame:
    """(source, day, id, call_count, late): the events per source and (UTC) day
    once the watermark has closed the day, and the events that came too late for
    their day, one by one with their ids.

    A source is counted in ``shares`` parts by id, so that a frequent one is
    spread; add up the parts when reading."""
    ship(events.sparkSession)
    share = F.pmod(F.xxhash64(id), F.lit(shares))
    rows = events.withWatermark("ts", wait).select(F.col(source).alias("key"), share.alias("share"), F.unix_micros("ts").alias("at"), F.col(id).cast("long").alias("id"))
    kind = events.schema[source].dataType.simpleString()
    out = rows.groupBy("key", "share").transformWithStateInPandas(DayCounts(), f"key {kind}, day_end long, id long, n long, late boolean", "append", "eventtime")
    day = F.date_sub(F.timestamp_millis("day_end").cast("date"), 1)
    return out.select(F.col("key").alias(source), day.alias("day"), "id", F.col("n").alias("call_count"), "late")
