"""Streams: what they keep between batches, and their results against SQL."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.plans import registry
from millrace.runtime import subfolders
from millrace.streaming import jobs, ordered, tables
from test_entry import SF, db, plain  # noqa: F401

STREAMS = ["stream_usage", "stream_closed_days", "stream_first_event", "stream_insert_absent", "stream_attempts", "stream_minimum_interval", "stream_filter", "stream_retention"]
BEGAN = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", STREAMS)
def test_stream_equals_sql(spark, db, name):  # noqa: F811
    frame, expected = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLE[name])
    got = plain([tuple(r[c] for c in expected.columns) for r in frame.collect()])
    assert got and got == plain(expected.fetchall())


def in_batches(spark, rows, schema, n, name):
    """Rows as a stream in ``n`` batches, in the order given."""
    df = spark.createDataFrame([(*r, i * n // len(rows)) for i, r in enumerate(rows)], f"{schema}, part int")
    return jobs.Arrivals(df, [F.col("part") == i for i in range(n)], name)


def gate_by_hand(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        last = None
        for _, ts, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if last is None or ts - last >= gap:
                out.append((key, ts, i))
                last = ts
    return sorted(out)


@pytest.mark.parametrize("gap,slot", [(60, 60), (7, 60), (600, 30)])
def test_gate_over_batches_is_exact_and_late_rows_change_nothing(spark, gap, slot):
    r = random.Random(gap)
    rows = sorted((("hot" if r.random() < 0.9 else r.choice("ab"), BEGAN + timedelta(minutes=r.randrange(6000), microseconds=r.choice([0, 7])), i) for i in range(1500)), key=lambda x: x[1])
    late = [("hot", BEGAN + timedelta(minutes=5), 9001), ("c", BEGAN + timedelta(minutes=30), 9002)]
    end = [("end", BEGAN + timedelta(days=90), 9003)]
    coming = in_batches(spark, [*rows, *end, *late], "k string, ts timestamp, id long", 5, "gate")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.minimum_interval(coming.stream, "k", "id", gap, "1 hour", slot * ordered.MINUTE), "gate", "append", coming).collect()
    assert out and sorted((x.key, x.ts, x.id) for x in out if not x.late) == gate_by_hand(rows, timedelta(minutes=gap))
    assert {x.id for x in out if x.late} == {9001, 9002}


def test_attempts_over_batches(spark):
    r = random.Random(4)
    rows = sorted(((r.choice(["hot", "hot", "hot", "a", None]), BEGAN + timedelta(seconds=r.randrange(90_000)), i, r.choice([True, False, False, None])) for i in range(900)), key=lambda x: x[1])
    coming = in_batches(spark, [*rows, ("end", BEGAN + timedelta(days=3), 9001, True)], "k string, ts timestamp, id long, ok boolean", 4, "attempts")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.attempts(coming.stream, "k", "id", "ok", 2), "attempts", "append", coming).collect()
    want, n = {}, {}
    for k, ts, i, ok in sorted(rows, key=lambda x: (x[1], x[2])):
        n[k] = 0 if ok else n.get(k, 0) + 1
        want[i] = (n[k], n[k] >= 2, False)
    assert {x.id: (x.failed_attempts, x.final, x.late) for x in out} == want


def test_attempts_tell_null_and_large_keys_apart(spark):
    rows = [(k, BEGAN + timedelta(minutes=i), i, False) for i, k in enumerate([None, 2**53 + 1, 2**53, 7] * 30)]
    coming = in_batches(spark, [*rows, (0, BEGAN + timedelta(days=3), 9001, True)], "k long, ts timestamp, id long, ok boolean", 2, "keys")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.attempts(coming.stream, "k", "id", "ok"), "keys", "append", coming).collect()
    assert {x.id: (x.key, x.failed_attempts) for x in out} == {i: (k, i // 4 + 1) for k, _, i, _ in rows}


class Store:
    """A state store that counts what it is asked, and its timers."""

    def __init__(self):
        self.calls, self.maps, self.value, self.ends = 0, {}, None, set()

    def called(self, result=None):
        self.calls += 1
        return result

    def getMapState(self, *_):
        return SimpleNamespace(getValue=lambda k: self.called(self.maps[k]), updateValue=lambda k, v: self.called(self.maps.update({k: v})), removeKey=lambda k: self.called(self.maps.pop(k)))

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.called(self.value), update=lambda v: self.called(setattr(self, "value", v)))

    def registerTimer(self, end):
        self.called(self.ends.add(end))


@pytest.mark.parametrize("block,part,most", [(ordered.BLOCK, ordered.PART, 60), (100, 300, 10**6)])
def test_attempts_ask_the_store_by_slot_not_by_key(monkeypatch, block, part, most):
    monkeypatch.setattr(ordered, "BLOCK", block)
    monkeypatch.setattr(ordered, "PART", part)
    r, slot, store = random.Random(block), 3_600_000, Store()
    rows = [(r.choice([None, *map(str, range(300))]), 1000 * r.randrange(8 * slot), i, r.random() < 0.4) for i in range(4000)]
    rows.sort(key=lambda x: x[1] // 1000 // slot // 4)  # two batches of four slots
    processor, out = ordered.Attempts(), []
    processor.init(store)
    for k in (0, 1):
        some = [x for x in rows if x[1] // 1000 // slot // 4 == k] + ([("late", 5, 9001, True)] if k else [])
        batch = pa.RecordBatch.from_pylist([dict(zip(("share", "key", "at", "id", "ok"), (0, *x), strict=True)) for x in some])
        frames = [b.to_pandas() for b in ordered._in_blocks([batch], slot)]
        out += processor.handleInputRows((0,), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda k=k: 4 * k * slot))
        for end in sorted(e for e in store.ends if e <= 4 * (k + 1) * slot):
            store.ends.remove(end)
            out += processor.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda end=end: end))
    want, n = {9001: ("late", -1, True)}, {}
    for key, _, i, ok in sorted(rows, key=lambda x: (x[1], x[2])):
        n[key] = 0 if ok else n.get(key, 0) + 1
        want[i] = (key, n[key], False)
    assert {i: (k, n, late) for f in out for k, i, n, late in f[["key", "id", "n", "late"]].itertuples(index=False)} == want
    assert not store.maps and not store.value[0] and store.calls <= most


def test_closed_days_and_late_rows_are_all_events(spark):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.8 else "b", BEGAN + timedelta(hours=r.randrange(24 * 9)), i) for i in range(700)]
    coming = in_batches(spark, [*rows, ("end", BEGAN + timedelta(days=30), 9000)], "k string, ts timestamp, id long", 3, "days")
    with ordered.rocksdb(spark):
        out = jobs.run_to_table(ordered.closed_days(coming.stream, "k", "id"), "days", "append", coming).collect()
    late = {x.id for x in out if x.late}
    assert late and len([x for x in out if x.late]) == len(late)
    assert sum(x.call_count for x in out) == 700
    for key in ("hot", "b"):
        for d in range(9):
            day = (BEGAN + timedelta(days=d)).date()
            there = [i for k, ts, i in rows if k == key and ts.date() == day]
            assert sum(x.call_count for x in out if x.k == key and x.day == day) == len(there)


SCHEMA = "k string, best struct<rank: int, id: bigint>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_copy_is_the_same_for_any_split(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(40)}", (r.randrange(5), i)) for i in range(400)]
    want = {}
    for k, best in rows:
        want[k] = min(want.get(k, best), best)
    r.shuffle(rows)
    cuts = sorted(r.sample(range(400), 4))
    table = tables.BucketTable(spark, f"{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], 8)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 400], strict=True)):
        for _ in range(2 if k == 2 else 1):  # a repeated batch changes nothing
            tables.keep_best(table, k, spark.createDataFrame(rows[a:b], SCHEMA), f"{tmp_path}/c")
    assert {x.k: tuple(x.best) for x in table.read(4).collect()} == want
    now = spark.read.parquet(*[f"{tmp_path}/c/{k}" for k in range(5)]).groupBy("id").agg(F.sum("change").alias("n")).collect()
    assert {x.n for x in now} == {0, 1} and {x.id for x in now if x.n == 1} == {i for _, i in want.values()}


def test_insert_absent_touches_only_its_buckets(spark, tmp_path):
    schema = "user string, n long, v string"
    table = tables.BucketTable(spark, f"{tmp_path}/t", spark.createDataFrame([], schema).schema, ["user"], 32)
    first = [(f"u{i % 50}", i, "x") for i in range(200)] + [(None, 5, "null key")]
    tables.insert_absent(table, 0, spark.createDataFrame(first, schema), ["n"], f"{tmp_path}/r")
    for _ in range(2):
        tables.insert_absent(table, 1, spark.createDataFrame([("u3", -1, "y"), ("new", 2, "y"), ("new", 1, "y")], schema), ["n"], f"{tmp_path}/r")
    assert len(subfolders(spark, f"{tmp_path}/t/rows/1")) <= 2 < len(subfolders(spark, f"{tmp_path}/t/rows/0"))
    got = {x.user: (x.n, x.v) for x in table.read(1).collect()}
    assert got == {**{f"u{i}": (i, "x") for i in range(50)}, None: (5, "null key"), "new": (1, "y")}
    assert tuple(spark.read.parquet(f"{tmp_path}/r/0").first()) == (201, 51, 150)
    assert tuple(spark.read.parquet(f"{tmp_path}/r/1").first()) == (3, 1, 2)
    tables.insert_absent(table, 2, spark.createDataFrame([], schema), ["n"], f"{tmp_path}/r")
    tables.insert_absent(table, 3, spark.createDataFrame([("u3", -9, "z")], schema), ["n"], f"{tmp_path}/r")
    assert {x.user: (x.n, x.v) for x in table.read(3).collect()} == got
    assert not subfolders(spark, f"{tmp_path}/t/manifest/0")


def test_retention_drops_days_and_rewrites_the_boundary(spark, tmp_path):
    schema = "id long, fetched_at timestamp"
    table = tables.DayTable(spark, f"{tmp_path}/t", spark.createDataFrame([], schema).schema, "fetched_at", 10)
    sent = spark.createDataFrame([(i,) for i in range(0, 400, 10)], "id long")
    rows = [(i, BEGAN + timedelta(hours=i)) for i in range(400)] + [(1000, None)]
    written = []
    kept = []
    for k in range(4):
        part = [x for x in rows if x[0] % 4 == k]
        now = BEGAN + timedelta(days=9 + 3 * k, hours=13)
        kept = [x for x in kept + part if x[1] is not None and (x[1] >= now - timedelta(days=10) or x[0] % 10 == 0)]
        for _ in range(2 if k == 2 else 1):
            removed = table.add(k, spark.createDataFrame(part, schema), sent, now)
        written.append(removed)
        assert sorted(tuple(x) for x in table.read().collect()) == sorted(kept)
    assert written[3].dropped and len(written[3].rewritten) == 1
    assert min(subfolders(spark, f"{tmp_path}/t/rows")) == "_day=2024-01-09"
    days = {x for x in subfolders(spark, f"{tmp_path}/t/rows")}
    assert all(any(b == "_batch=3" for b in subfolders(spark, f"{tmp_path}/t/rows/{d}")) for d in days)  # what a batch adds lies beside, nothing is written twice


def test_the_store_is_set_for_these_streams_alone(spark):
    before = spark.conf.get(ordered.PROVIDER)
    with pytest.raises(ZeroDivisionError), ordered.rocksdb(spark):
        assert spark.conf.get(ordered.PROVIDER) == ordered.ROCKSDB
        1 / 0
    assert spark.conf.get(ordered.PROVIDER) == before
