import pytest
from pyspark.sql import functions as F

from millrace.functions import money, web
from millrace.functions import text as X
from millrace.operators import grounding, redact
from millrace.operators.replies import clean_reply, first_object
from millrace.operators.scoring import final_score


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in cols.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "phrase", "found"), [
    ("Senior Back-End Engineer", "back end", True), ("javascript", "java", False), ("C_plus/plus", "c plus plus", True), ("", "a", False), ("été1", "1", True), ("x", "", False)])
def test_phrases_are_bounded(spark, text, phrase, found):
    assert one(spark, X.contains_any(F.col("t"), [phrase]), t=text) is found


def test_phrase_removal_is_longest_first(spark):
    assert one(spark, X.remove_phrases(F.col("t"), ["work", "work from home"]), t="Work from  home - remote work") == "remote"


@pytest.mark.parametrize(("title", "segment"), [("Lead Engineer, Payments", "Lead Engineer"), ("A-B – C", "A-B"), ("Plain", "Plain"), ("X (remote)", "X")])
def test_primary_segment(spark, title, segment):
    assert one(spark, X.primary_segment(F.col("t")), t=title) == segment


@pytest.mark.parametrize(("text", "low", "high", "currency"), [
    ("$120,000 - $160,000", 120000, 160000, "USD"), ("$31,2k- $52k", 31200, 52000, "USD"), ("€60k-80k", 60000, 80000, "EUR"), ("£50,000", 50000, 50000, "GBP"), ("$50 per hour", 104000, 104000, "USD"),
    ("competitive", None, None, None), ("$50k or €60k", None, None, None), ("90k-70k", 70000, 90000, None)])
def test_salary_text(spark, text, low, high, currency):
    got = one(spark, money.parse_salary(F.col("t")), t=text)
    assert (got["min"], got["max"], got["currency"], got["known"]) == (low, high, currency, low is not None)


@pytest.mark.parametrize(("url", "mode", "expected"), [
    ("https://a.example/x", "hosts", None), ("https://b.example/x", "hosts", "host"), ("http://a.example/", "hosts", "invalid_url"), ("garbage", "any-https", "invalid_url"),
    ("https://u:p@b.example/", "any-https", "invalid_url"), ("https://10.0.0.1/", "any-https", "invalid_url"), ("https://[::1]/", "any-https", "invalid_url"), ("https://z.example/", "any-https", None), ("https://z.example/", None, "host")])
def test_url_check(spark, url, mode, expected):
    assert one(spark, web.url_rejection(F.col("u"), F.col("m"), F.array(F.lit("a.example"))), u=url, m=mode) == expected


def test_html_to_text(spark):
    assert one(spark, X.html_to_text(F.col("t")), t="<p>Hel<b>lo</b></p><script>x()</script><style>p{}</style>&lt;i&gt;A&lt;/i&gt; &amp;#66;&#x43;") == "HelloA BC"


def test_secrets_in_logs(spark):
    t = "GET https://u:p@h.example/a?page=2&api_key=abc&auth=x1 Bearer abc.def sk-abcdefgh1234 postgres://me:pw@host signature: zzz"
    got = one(spark, X.scrub_secrets(F.col("t")), t=t)
    assert "page=2" in got and not any(x in got for x in ("u:p", "=abc", "abc.def", "sk-abc", "me:pw", "x1", "zzz"))


@pytest.mark.parametrize(("x", "y", "expected"), [((90, 60, 100, 100, 70), None, 85), ((80, 60, 100, 50, 40), None, 71)])
def test_final_score_rounds_half_up(spark, x, y, expected):
    names = ["skills", "seniority", "location", "salary", "company"]
    parts = {n: F.lit(v) for n, v in zip(names, x, strict=True)}
    assert spark.range(1).select(final_score(parts, dict(zip(names, (40, 20, 15, 15, 10), strict=True)))).first()[0] == expected


def test_numbers_and_number_words(spark):
    assert one(spark, X.numbers(F.col("t")), t="50K users, 50,000 rows and 3.5 of 2") == [50000.0, 50000.0, 3.5, 2.0]
    assert one(spark, grounding.number_words(F.col("t")), t="two hundred rows or three thousand") == [200, 3000]
    assert one(spark, grounding.number_words(F.col("t")), t="One of the twenty-five, one year") == [25, 1]
    assert one(spark, grounding.number_words(F.col("t"), claims=False), t="one of them, two hundredth, one-time") == [1, 2, 1]
    assert one(spark, grounding.number_words(F.col("t")), t="three million two hundred thousand five, hundred, stone") == [3200005, 100]


def test_phone_redaction(spark):
    df = spark.createDataFrame([("Call +91 98765 43210 or (555) 123-4567, 555-123-4567, 98765 43210; 9876543210 users, $9876543210, 1200000 users, 2024, 1.2.3, 2024-10-03; mail a.b@c.example, linkedin.com/in/me",)], "text string")
    got = redact.redact(df).first()
    assert got["n_email"] == 1 and got["n_phone"] == 4 and got["n_url"] == 1 and "2024-10-03" in got["redacted"] and "1200000 users" in got["redacted"]
    assert redact.redact(df.select(F.lit(got["redacted"]).alias("text"))).first()["redacted"] == got["redacted"]


def test_replies(spark):
    assert first_object('x {"a": "}{"} y') == ('{"a": "}{"}', None)
    assert first_object("no") == (None, "none") and first_object("{") == (None, "unbalanced")
    assert one(spark, clean_reply(F.col("t")), t="<think>a</think>```json\n{}\n```<think>open") == "{}"


GOOD = "Dear Hiring Team,\n\nI know Java and Kafka.\n\nI built five services in Java.\n\n{{NAME}}"


@pytest.mark.parametrize(("letter", "codes"), [
    (GOOD, []), ("  ", ["empty"]), (GOOD.replace("Dear", "Hello"), ["salutation"]), (GOOD + "\nBye", ["sign_off"]), (GOOD.replace("five", "six"), ["ungrounded_number"]),
    (GOOD.replace("services in Java", "services in Kafka"), ["ungrounded_technology"]), (GOOD.replace("services", "banking services"), ["ungrounded_domain"]),
    (GOOD.replace("services", "Contoso Banking services"), []), (GOOD.replace("I built", "**I** built [x]"), ["other_placeholder", "markdown"]),
    (GOOD.replace("I built", "See www.a.example, I built"), ["url", "pii"]), (GOOD.replace("I built", "As the profile says, I built"), ["internal_label"]),
    (GOOD.replace("{{NAME}}", "{{NAME}} {{NAME}}"), ["name_placeholder_count"]), (GOOD.replace("Java.", "Java" + " a" * 200 + "."), ["too_long"])])
def test_letters(spark, letter, codes):
    source = "Five services in Java"
    got = grounding.letter_codes(F.col("t"), F.col("s"), ["banking"], ["Java", "Kafka"], company=F.lit("Contoso Banking"))
    assert one(spark, got, t=letter, s=source) == codes


def test_sections(spark):
    df = spark.createDataFrame([(1, "Hello\nSKILLS\nJava\nWork Experience:\nOne\nTwo\nHOBBIES\nChess")], "doc_id long, text string")
    got = {r.section: r.text for r in grounding.sections(df).collect()}
    assert got == {"other": "Hello\nChess", "skills": "Java", "experience": "One\nTwo"}
