"""Every registered query outside the llm subpackage against its SQL."""

import duckdb
import pytest

from millrace.plans import feeds, records, registry, ruletexts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    f = lambda v: None if v is None or v != v else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(map(f, r)) for r in rows], key=repr)


@pytest.mark.parametrize("name", ["filter_first_reason", "filter_funnel", "daily_ranking", "best_copy_per_key", "insert_if_absent", "company_upsert", "usage_by_day", "attempt_cap", "run_status", "phrase_filter", "normalised_words", "url_check", "letter_rule_codes", "secret_scrub",
    "sections_of_doc", *feeds.QUERIES, *records.QUERIES, *ruletexts.QUERIES])
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    expected = db.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain([tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall()])
