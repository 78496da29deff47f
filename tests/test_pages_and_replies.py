"""Page files and stops, sections, reply schemas, pieces of texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import table
from millrace.operators import grounding, reports, schemas
from millrace.plans import feeds, registry
from millrace.sources import adapters, files
from millrace.streaming import jobs
from test_entry import SF, db, plain  # noqa: F401

RAW = "source string, board string, page_no int, fetched_at timestamp, body string"


@pytest.mark.parametrize("name", ["judgement_replies", "matrix_replies", "text_pieces", "extracted_objects", "numbers_per_doc", "sanitised_texts", "request_texts", "suggestion_lists", "letter_rule_codes", "vocabulary_terms", "pii_counts", "pii_values", "pii_leaks_after_redaction", "address_lines", "email_counts"])
def test_query_equals_sql(spark, db, name):  # noqa: F811
    frame, expected = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLE[name])
    assert plain([tuple(r[c] for c in expected.columns) for r in frame.collect()]) == plain(expected.fetchall())


def pages(spark, sizes, root="hits", board="b", first=0, **fields):
    made = [(("s", board, first + i, None, json.dumps({root: [{"id": f"{board}{i}-{j}", "objectID": f"{board}{i}-{j}", "comment_text": "Co | Engineer", "parent_id": "2", **fields} for j in range(n)]}))) for i, n in enumerate(sizes)]
    return spark.createDataFrame(made, RAW)


def test_pages_end_at_a_short_page_and_at_the_bound(spark):
    raw = pages(spark, [3, 3, 2, 3]).unionByName(pages(spark, [3, 3, 3, 3], board="c", first=1)).unionByName(spark.createDataFrame([("s", "d", 5, None, "no json"), ("s", "d", 6, None, '{"hits":[1,2,3]}'), (None, None, 1, None, '{"hits":[1,2,3]}')], RAW))
    left = lambda n: sorted((r.board or "", r.page_no) for r in adapters.until_stop(raw, adapters.short_page("hits", 3), n).collect())
    assert left(50) == [("", 1), *[("b", i) for i in (0, 1, 2)], *[("c", i) for i in (1, 2, 3, 4)], ("d", 5)]
    assert left(2) == [("", 1), ("b", 0), ("b", 1), ("c", 1), ("c", 2), ("d", 5)]
    plan = adapters.until_stop(raw, adapters.short_page("hits", 3), 2)._jdf.queryExecution().toString()
    assert "Window" not in plan
    threads = spark.createDataFrame([("s", "b", 0, None, '{"hits":[{"objectID":"2","title":"Who is hiring?","created_at_i":1}]}')], RAW)
    assert {r.external_id[:2] for r in adapters.forum_thread(threads, pages(spark, [3, 3, 2, 3]), page_size=3).collect()} == {"b0", "b1", "b2"}
    assert {r.external_id[:2] for r in adapters.search_api(pages(spark, [3, 1, 3], "results"), page_size=3).collect()} == {"b0", "b1"}


def test_records_of_broken_pages(spark):
    raw = spark.createDataFrame([("s", "b", i, None, x) for i, x in enumerate([None, "", "{", "[]", '{"jobs":{"a":1}}', '{"jobs":null}', '{"jobs":[1,{"id":2}]}', '[{"id":3}]'])], RAW)
    assert sorted((r.page_no, r.pos) for r in adapters.records(raw, "jobs").collect()) == [(6, 0), (6, 1)]
    assert [(r.page_no, r.pos) for r in adapters.records(raw, None).collect()] == [(7, 0)]
    assert "to_json" not in adapters.records(raw, "jobs")._jdf.queryExecution().toString()


def test_pages_from_files_as_table_and_stream(spark, tmp_path):
    rows = feeds.base(spark, SF).where("id < 700")
    raw = feeds._paged(rows, feeds._json(guid=F.col("id").cast("string"), title=F.col("title")), "cursor", "jobs", lambda x: F.concat(F.lit('"nextCursor":'), x))
    files.write_pages(raw, f"{tmp_path}/in")
    key = ["source", "board", "page_no", "body"]
    read = files.read_pages(spark, f"{tmp_path}/in")
    assert plain(read.select(*key).collect()) == plain(raw.withColumn("board", F.col("board")).select(*key).collect())
    want = plain(adapters.cursor_feed(raw).select("external_id", "title").collect())
    assert want and plain(adapters.cursor_feed(read).select("external_id", "title").collect()) == want
    step = files.each_batch(adapters.cursor_feed, lambda df, k: df.select("external_id", "title").write.mode("overwrite").parquet(f"{tmp_path}/out/{k}"))
    at, last = jobs.run_batches(files.read_pages(spark, f"{tmp_path}/in", stream=True), "pages", lambda _, batch, k: step(batch, k))
    assert last == 0 and plain(spark.read.parquet(f"{tmp_path}/out/0").collect()) == want


def test_statuses_are_observed_while_rows_are_written(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("z", True)], "board string, ok boolean")
    table_, status = reports.observed_status(rows, ["a", "b", "c"])
    assert [tuple(r) for r in status.collect()] == [("a", 2, 1, "ok"), ("b", 1, 0, "error"), ("c", 0, 0, "ok")]
    assert table_.count() == 4 and table_.inputFiles()


def test_sections_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "a\nSKILLS\nx\nProfile:\np\nSkills\ny"), (1, "Skills\nz\n\nEDUCATION"), (2, None), (3, ""), (3, "\nBIG HEADING\nq")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section, r.text) for r in grounding.sections(docs).collect())
    assert got == [(1, "other", "a"), (1, "skills", "x\ny"), (1, "skills", "z"), (1, "summary", "p"), (3, "other", "q")]
    assert not re.search("Window|Exchange", grounding.sections(docs)._jdf.queryExecution().toString())


def test_schemas_give_typed_paths(spark):
    good = {"skillsFit": 1, "seniorityFit": 100.0, "matchedSkills": [" a  b ", "", "c" * 90], "missingSkills": [], "redFlags": list("abcd"), "reason": " why ", "roleType": "lead", "score": 5}
    cases = [
        (json.dumps(good), []), (None, ["$: not an object"]), ("[]", ["$: not an object"]), ("{", ["$: not an object"]), ("5", ["$: not an object"]),
        (json.dumps(good | {"skillsFit": "1", "seniorityFit": 101, "reason": " ", "roleType": "x", "matchedSkills": "a", "redFlags": ["a", 1, None]}),
         ["skillsFit: not a number", "seniorityFit: out of range", "matchedSkills: not a list", "redFlags[1]: not a text", "redFlags[2]: not a text", "reason: empty", "roleType: not allowed"]),
        ("{}", ["skillsFit: not a number", "seniorityFit: not a number", "matchedSkills: not a list", "missingSkills: not a list", "redFlags: not a list", "reason: not a text", "roleType: not a text"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, json string")
    out = schemas.validate(df, schemas.JUDGEMENT).orderBy("i").collect()
    assert [list(r.errors) for r in out] == [e for _, e in cases] and [r.valid for r in out] == [not e for _, e in cases]
    v = out[0].value
    assert (v.skillsFit, v.redFlags, v.reason, v.missingSkills, v.matchedSkills[0], len(v.matchedSkills), len(v.matchedSkills[1])) == (1.0, ["a", "b", "c"], "why", [], "a b", 2, 80) and "score" not in v.asDict()
    assert all(r.value is None for r in out[1:])
    table_ = spark.createDataFrame([(f.path, f.kind, f.least if f.least is None else float(f.least), f.most if f.most is None else float(f.most), f.items, f.length, f.filled, list(f.allowed) if f.allowed else None) for f in schemas.MATRIX], "path string, kind string, least double, most double, items int, length int, filled boolean, allowed array<string>")
    assert [f[:1] + f[6:] for f in schemas.from_table(table_)] == [f[:1] + f[6:] for f in schemas.MATRIX]


def test_pieces_of_a_text_from_sql(spark):
    table.register(spark)
    docs = spark.createDataFrame([(1, "é a.b@c.example, 1,000 www.x.example/5)."), (2, None), (3, "")], "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, p.* FROM {docs} d, LATERAL text_pieces(d.text) p", docs=docs).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 15, "email", "a.b@c.example"), (1, 17, 22, "number", "1,000"), (1, 23, 38, "url", "www.x.example/5"), (1, 37, 38, "number", "5")]
    text = "".join(random.Random(1).choice("a@.1, k/wé") for _ in range(2000))
    assert all(text[a:b] == piece for a, b, _, piece in table.pieces(text))
