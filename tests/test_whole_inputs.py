"""Queries that take whole texts and whole tables, against their SQL."""

import pytest

from millrace.plans import registry
from test_entry import SF, db, plain  # noqa: F401


def same(spark, db, name):  # noqa: F811
    got, expected = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLE[name])
    assert sorted(expected.columns) == sorted(got.columns)
    rows = plain([tuple(r[c] for c in sorted(got.columns)) for r in got.collect()])
    assert rows == plain([tuple(r[expected.columns.index(c)] for c in sorted(got.columns)) for r in expected.fetchall()])
    return rows


@pytest.mark.parametrize("name", ["keep_first_per_id", "keep_first_per_text", "keep_first_per_url"])
def test_keep_first_by_whole_keys(spark, db, name):  # noqa: F811
    rows = same(spark, db, name)
    table, key = {"keep_first_per_id": ("documents", "doc_id"), "keep_first_per_text": ("documents", "text"), "keep_first_per_url": ("pages", "url")}[name]
    assert len(rows) <= db.sql(f"SELECT count(DISTINCT {key}) FROM {table}").fetchall()[0][0]


@pytest.mark.parametrize("name", ["insert_if_absent", "insert_report", "company_upsert", "insert_if_absent_whole", "insert_report_whole", "company_upsert_whole", "retained_outcomes"])
def test_whole_tables(spark, db, name):  # noqa: F811
    rows = same(spark, db, name)
    orders, customers = (db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("orders", "customer"))
    if name == "insert_report_whole":
        assert int(rows[0][2]) == orders  # received
    elif name != "insert_report":
        assert len(rows) >= 0.98 * {"company_upsert": customers, "company_upsert_whole": customers}.get(name, orders)


def test_retained_keys_make_duplicates(spark):
    from pyspark.sql import functions as F

    from millrace.plans import core

    rows = [(i, "s1", i < 3, None if i < 3 else "too_old", "text", False, f"k{i % 2}") for i in range(1, 5)]
    frame = spark.createDataFrame(rows, "id long, source string, passed boolean, reason string, description string, description_is_snippet boolean, dedupe_key string")
    frame = frame.unionByName(frame.where("id = 2").withColumns({"id": F.lit(7).cast("long"), "source": F.lit("s9")}))
    before, core.evaluated = core.evaluated, lambda *_: frame
    try:
        got = {r.id: r.outcome for r in core.decided(spark, "", "id = 7").collect()}
    finally:
        core.evaluated = before
    assert got == {1: "shortlisted", 2: "duplicate", 7: "duplicate", 3: "too_old", 4: "too_old"}


def test_passages_are_whole_texts(spark, db):  # noqa: F811
    from millrace.plans import corpus

    assert same(spark, db, "excerpt_search")
    start = "one two three four five six seven eight n"
    docs = spark.createDataFrame([(1, f"x {start}ine ten"), (2, f"x {start}o"), (3, "blue sky")], "doc_id long, t string")
    items = spark.createDataFrame([(1, f"{start}ine"), (2, "ue sky"), (3, "two three fourteen")], "item_id long, e string")
    assert {tuple(r) for r in corpus.passages(docs, items).collect()} == {(1, 1), (3, 2)}


def test_long_aliases_are_found(spark):
    from millrace.operators import vocab

    lines = spark.createDataFrame([("general data protection and privacy rule",), ("Go",)], "value string")
    texts = spark.createDataFrame([(1, "The General Data Protection and Privacy Rule holds")], "doc_id long, text string")
    assert vocab.find_terms(texts, vocab.read_vocabulary(lines)).first().terms == ["general data protection and privacy rule"]


def test_fetch_report(spark, db):  # noqa: F811
    assert same(spark, db, "fetch_report")


@pytest.mark.parametrize("name", ["feed_forum", "feed_search"])
def test_feeds_of_many_and_of_short_pages(spark, tmp_path, name):
    import duckdb

    # 106 pages, none of them full, and a gap of 300 empty ones
    key = "o_orderkey * 7 + CASE WHEN o_orderkey > 900 THEN 30000 ELSE 0 END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({key} AS o_orderkey) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (FROM '{SF}/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    sql = duckdb.connect()
    for t in ("orders", "customer"):
        sql.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got, expected = registry.QUERIES[name](spark, str(tmp_path)), sql.sql(registry.ORACLE[name])
    rows = plain([tuple(r[c] for c in expected.columns) for r in got.collect()])
    assert len(rows) > 1000 and rows == plain(expected.fetchall())


def test_pages_without_a_bound(spark):
    from millrace.sources import adapters

    raw = spark.createDataFrame([("s", "b", i, None, f'{{"results":[{{"id":"{i}"}}]}}') for i in range(60)], "source string, board string, page_no int, fetched_at timestamp, body string")
    pages = lambda **k: sorted(int(r.external_id) for r in adapters.search_api(raw, **k).collect())
    assert pages(page_size=1) == list(range(60)) == pages(page_size=None)
    assert pages(page_size=1, max_pages=7) == list(range(7)) == pages(page_size=None, max_pages=7) and pages() == [0]
