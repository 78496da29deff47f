from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import dedupe, filters, reports, scoring, state, vocab
from millrace.rules import Rules
from millrace.sources import adapters

NOW = datetime(2024, 1, 31)
ROW = dict(id=1, title="Data Engineer", company="Acme", location="Remote", description="", salary_min=90000.0, salary_max=120000.0, currency="USD", salary_known=True, salary_is_estimated=False,
           posted_at=datetime(2024, 1, 30), fetched_at=datetime(2024, 1, 31), description_is_snippet=False)
SCHEMA = ("id long, title string, company string, location string, description string, salary_min double, salary_max double, currency string, salary_known boolean, salary_is_estimated boolean, "
          "posted_at timestamp, fetched_at timestamp, description_is_snippet boolean")
RULES = Rules(include_keywords=("engineer",), exclude_functions=("sales",), blocked=("Bad Co.",), exclude_keywords=("intern",), exclude_employment=("part time",))


def rows(spark, *changes):
    return filters.with_companies(spark.createDataFrame([tuple((ROW | {"id": i} | c).values()) for i, c in enumerate(changes)], SCHEMA))


def test_first_reason_wins(spark):
    got = filters.evaluate(rows(
        spark, {}, {"company": "BAD co", "title": "x"}, {"posted_at": datetime(2024, 1, 1)}, {"title": "Sales Engineer"}, {"title": "Chef"}, {"title": "Part-time engineer"}, {"salary_max": 10.0},
        {"location": "US only"}, {"location": "Berlin"}, {"location": "Bengaluru"}, {"location": "Worldwide"}, {"salary_known": False}, {"location": None}, {"title": None}), RULES, NOW).orderBy("id").collect()
    assert [r.reason for r in got] == [
        None, "blocked_company", "too_old", "title_excluded", "title_no_match", "employment_type", "salary_below_min", "onsite_other_location", "onsite_other_location", "not_gcc", None, None, None, "title_no_match"]
    assert [r.passed for r in got] == [r.reason is None for r in got]
    assert got[10].region == "open" and got[11].notes == "salary_unknown"


def test_region_from_description(spark):
    got = filters.evaluate(rows(spark, {"description": "You must be located in the US"}, {"description": "must be located in the US or worldwide"}), RULES, NOW).orderBy("id").collect()
    assert [(r.reason, r.notes) for r in got] == [("region_restricted", "US"), (None, "")]


def test_explain_has_every_rule(spark):
    assert filters.explain(rows(spark, {}, {"title": "Chef"}), RULES, NOW).count() == 10


def test_best_copy_and_duplicates(spark):
    df = spark.createDataFrame([(1, "s9", True, 900), (2, "s1", False, 10), (3, "s2", False, 20), (4, "s1", False, 20)], "id long, source string, description_is_snippet boolean, description_length int")
    df = df.withColumn("dedupe_key", F.lit("k"))
    assert dedupe.best_ids(df, ["s1", "s2"]).first()["best_id"] == 4
    none = df.select("dedupe_key", "id").limit(0)
    got = dedupe.duplicate_reason(df, ["s1", "s2"], none.select("dedupe_key"), df.where("id = 4").select("dedupe_key", "id"), F.lit(True))
    assert {r.id: r.duplicate for r in got.collect()} == {1: "duplicate", 2: "duplicate", 3: "duplicate", 4: None}


def test_cap_and_ranking(spark):
    df = spark.createDataFrame([(i, i % 4, bool(i % 2), datetime(2024, 1, 1)) for i in range(10)], "id long, score int, company_preferred boolean, fetched_at timestamp").withColumn("posted_at", F.lit(None).cast("timestamp"))
    assert {r.id for r in scoring.cap(df, 3, "score").where("not capped").collect()} == {3, 7, 2}
    got = scoring.rank_list(df, df.where("id = 3").select("id"), Rules(top_count=2, extra_count=3, min_score=1)).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 2, 6, 1, 5] and [r.section for r in got] == ["top", "top", "extra", "extra", "extra"]
    assert scoring.cap(df.limit(0), 3, "score").count() == 0


def test_state_merges(spark):
    old = spark.createDataFrame([("a", "1", "old")], "source string, external_id string, title string")
    new = spark.createDataFrame([("a", "1", "new"), ("a", "2", "x"), ("a", "2", "y"), ("a", "3", None)], old.schema)
    got = state.insert_if_absent(old, new, ["source", "external_id"], ["title"], ["title"])
    assert {tuple(r) for r in got.result.collect()} == {("a", "1", "old"), ("a", "2", "x")}
    assert tuple(got.report.first()) == (4, 1, 2, 1)
    days = spark.createDataFrame([("a", datetime(2023, 1, 1)), ("b", datetime(2023, 1, 1)), ("c", datetime(2024, 1, 30))], "id string, fetched_at timestamp")
    purged = state.purge(days, days.where("id = 'b'").select("id"), NOW, 30)
    assert {r.id for r in purged.result.collect()} == {"b", "c"} and purged.removed.first()[0] == 1


def test_usage(spark):
    days = spark.createDataFrame([("s", "2024-01-01", 2), ("s", "2024-01-02", 1), ("s", "2023-12-31", 1)], "source string, day string, call_count long").withColumn("day", F.col("day").cast("date"))
    policy = spark.createDataFrame([("s", 2, 4), ("t", 0, 9)], "source string, day_cap int, month_cap int")
    got = {r.source: tuple(r)[1:] for r in reports.budget(days, policy, F.lit("2024-01-02").cast("date")).collect()}
    assert got == {"s": (1, 3, True), "t": (0, 0, False)}


def test_vocabulary(spark):
    lines = spark.createDataFrame([(x,) for x in ("# c", "", "Java", "JavaScript|JS", "C", "C++", "PostgreSQL|Postgres", "AWS", "AWS SQS", "=Go")], "value string")
    texts = spark.createDataFrame([(1, "C and C++, Java and JavaScript"), (2, "Postgres and PostgreSQL on AWS SQS; go"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.terms for r in vocab.find_terms(texts, vocab.read_vocabulary(lines)).collect()}
    assert got == {1: ["C", "C++", "Java", "JavaScript"], 2: ["PostgreSQL", "AWS SQS"], 3: []}


def raw(spark, body, source="s", board="b", page=1):
    return spark.createDataFrame([(source, board, page, NOW, body)], "source string, board string, page_no int, fetched_at timestamp, body string")


def test_adapters(spark):
    body = '[{"legal":"x"},{"id":7,"position":"Dev","company":"A","tags":["x",3],"salary_min":0,"salary_max":90000,"url":"https://a.example/7","date":"2024-01-02T03:04:05-04:00","description":"<p>Hi</p>"}]'
    got = adapters.remote_list(raw(spark, body)).collect()
    assert len(got) == 1 and (got[0].external_id, got[0].salary_min, got[0].salary_max, got[0].currency, got[0].description) == ("7", None, 90000.0, "USD", "Hi")
    body = '{"jobs":[{"id":1,"title":"T","company_name":"C","candidate_required_location":"Worldwide","salary":"$50k - $60k","publication_date":"2024-01-02T03:04:05","url":"https://r.example/1"}]}'
    got = adapters.category_feed(raw(spark, body)).first()
    assert (got.salary_min, got.salary_max, got.posted_at) == (50000.0, 60000.0, datetime(2024, 1, 2, 3, 4, 5))
    body = "<rss><channel><item><title>Co: Job: A</title><link>https://w.example/1</link><region>Anywhere</region><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>x</title></item></channel></rss>"
    got = adapters.rss_feed(raw(spark, body)).collect()
    assert [(r.company, r.title, r.external_id, r.posted_at) for r in got] == [("Co", "Job: A", "https://w.example/1", datetime(2024, 1, 2, 3, 4, 5))]
    pages = raw(spark, '{"jobs":[{"guid":"g1","title":"A","minSalary":50,"salaryPeriod":"hourly"}],"nextCursor":"n"}').unionByName(
        raw(spark, '{"jobs":[{"guid":"g2","title":"B"}],"nextCursor":null}', page=2)).unionByName(raw(spark, '{"jobs":[{"guid":"g3"}]}', page=3))
    got = {r.external_id: (r.salary_min, r.salary_max) for r in adapters.cursor_feed(pages).collect()}
    assert got == {"g1": (104000.0, 104000.0), "g2": (None, None)}
    boards = spark.createDataFrame([("b", "Acme")], "slug string, company string")
    body = '{"jobs":[{"id":"1","title":"A","isListed":false},{"id":"2","title":"B","isRemote":true,"compensation":{"compensationTiers":[{"components":[{"compensationType":"Equity"},{"compensationType":"Salary","minValue":1,"maxValue":2,"currencyCode":"EUR"}]}]}}]}'
    got = adapters.board_c(raw(spark, body), boards).collect()
    assert [(r.external_id, r.company, r.remote_type, r.salary_max, r.currency) for r in got] == [("2", "Acme", "remote", 2.0, "EUR")]
