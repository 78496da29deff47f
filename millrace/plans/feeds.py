"""Feed queries: orders and customers written as the payloads of ten feeds, 100
records a page, read back by the adapters.  The SQL derives the postings straight
from the tables.  A page holds what there is of a hundred ids, so a short page
says nothing about the pages behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import reports
from millrace.runtime import read
from millrace.sources import adapters

PAGE = 100
COLUMNS = [
    "external_id", "title", "company", "location", "remote_type", "salary_min", "salary_max", "currency", "salary_known", "salary_is_estimated", "url", "posted", "description",
    "description_is_snippet"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, company, pay, iso (UTC text), epoch, and a description in HTML."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.col("o_totalprice").alias("pay"), iso.alias("iso"))
    rows = rows.withColumn("epoch", F.unix_timestamp(F.to_timestamp("iso"))).withColumn("html", F.concat(F.lit("<p>About <b>"), "company", F.lit("</b> &amp; more</p>")))
    return rows.withColumn("title", F.concat(F.lit("Role "), (F.col("id") % 7).cast("string"))).withColumn("link", F.concat(F.lit("https://jobs.example/"), F.col("id").cast("string")))


def payloads(rows: DataFrame, element: Column, source: str, open_: str, close: Column, board: Column | None = None, pages: int | None = None) -> DataFrame:
    """raw rows: pages of PAGE elements, joined between ``open_`` and ``close``;
    ``pages`` to a board."""
    no = F.floor(F.col("id") / PAGE)
    board = board if board is not None else F.lit("all") if pages is None else F.floor(no / pages).cast("string")
    page_no = no if pages is None else no % pages
    parts = rows.groupBy(board.alias("board"), page_no.cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("id", element.alias("j")))).alias("xs"))
    body = F.concat(F.lit(open_), F.array_join(F.transform("xs", lambda x: x["j"]), ","), close)
    return parts.select(F.lit(source).alias("source"), "board", "page_no", F.lit(None).cast("timestamp").alias("fetched_at"), body.alias("body"))


def shown(postings: DataFrame) -> DataFrame:
    return postings.withColumn("posted", F.unix_timestamp("posted_at")).select(*COLUMNS)


def _each(n: int, value, other=None) -> Column:
    """``value`` where the id is no multiple of n, else ``other``."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.col("id") % n != 0, lit(value)).otherwise(lit(other))


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def feed_remote_list(spark, sf_dir):
    e = _json(
        id=F.col("id"), position=F.concat(F.lit(" "), "title"), company=_each(11, F.col("company")), location=_each(5, "Paris", ""), tags=F.array(_each(3, "go", "onsite")),
        salary_min=_each(7, F.col("pay"), 0.0), salary_max=_each(7, F.col("pay") * 2), date=_each(2, F.col("iso")), epoch=F.col("epoch"), url=_each(13, F.col("link")), apply_url=F.lit("https://apply.example/"),
        description=F.col("html"))
    return shown(adapters.remote_list(payloads(base(spark, sf_dir), e, "remote", '[{"legal":"notice","last_updated":1},', F.lit("]"))))


def feed_category(spark, sf_dir):
    pay = F.element_at(F.array(F.lit("$50k - $60k"), F.lit("competitive"), F.lit("£40,000"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    e = _json(
        id=F.col("id").cast("string"), title=F.col("title"), company_name=F.col("company"), url=F.col("link"), tags=F.array(F.lit("x")), candidate_required_location=_each(5, "Hybrid Berlin"), salary=pay,
        publication_date=_each(2, F.col("iso"), F.regexp_replace("iso", "Z$", "")), description=F.col("html"))
    return shown(adapters.category_feed(payloads(base(spark, sf_dir), e, "category", '{"notice":"n","jobs":[', F.lit("]}"))))


def feed_rss(spark, sf_dir):
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title = F.concat(F.col("company"), F.when(F.col("id") % 9 != 0, F.concat(F.lit(": "), "title")).otherwise(""))
    e = tag("item", F.concat(
        tag("title", title), tag("link", F.col("link")), F.when(F.col("id") % 3 != 0, tag("region", F.lit("Anywhere"))).otherwise(""), tag("country", F.lit("France")),
        tag("description", F.lit("&lt;p&gt;One &lt;b&gt;two&lt;/b&gt;&lt;/p&gt;")),
        tag("pubDate", F.concat(F.date_format(F.to_timestamp_ntz(F.regexp_replace("iso", "Z$", "")), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))))
    raw = payloads(base(spark, sf_dir), e, "rss", "<rss><channel>", F.lit("</channel></rss>"))
    return shown(adapters.rss_feed(raw.withColumn("body", F.regexp_replace("body", "</item>,<item>", "</item><item>"))))


def _paged(rows: DataFrame, element: Column, source: str, root: str, tail) -> DataFrame:
    """Ten pages to a board; every second board has no next link on page 8."""
    raw = payloads(rows, element, source, f'{{"{root}":[', F.lit("]"), pages=10)
    last = (F.col("page_no") == 8) & (F.col("board").cast("int") % 2 == 0)
    return raw.withColumn("body", F.concat("body", F.lit(","), tail(F.when(last, "null").otherwise('"next"')), F.lit("}")))


def feed_cursor(spark, sf_dir):
    e = _json(
        guid=F.col("id").cast("string"), title=F.col("title"), companyName=F.col("company"), minSalary=_each(3, F.lit(30.0), F.lit(None).cast("double")), maxSalary=_each(4, F.lit(40.0), F.lit(None).cast("double")),
        salaryPeriod=_each(2, "hourly", "annual"), currency=F.lit("USD"), locationRestrictions=F.when(F.col("id") % 5 != 0, F.array(F.lit("India"), F.lit("Spain"))).otherwise(F.array().cast("array<string>")),
        pubDate=F.col("epoch"), applicationLink=F.col("link"), description=F.col("html"))
    return shown(adapters.cursor_feed(_paged(base(spark, sf_dir), e, "cursor", "jobs", lambda x: F.concat(F.lit('"nextCursor":'), x))))


def feed_flag(spark, sf_dir):
    e = _json(
        slug=F.concat(F.lit("s"), (F.col("id") - F.when(F.col("id") % 50 == 1, 1).otherwise(0)).cast("string")), title=F.col("title"), company_name=F.col("company"), remote=F.col("id") % 3 != 0,
        tags=F.array(F.lit("a")), location=_each(5, "On-site Lyon"), url=F.col("link"), created_at=F.col("epoch"), description=F.col("html"))
    return shown(adapters.flag_feed(_paged(base(spark, sf_dir), e, "flag", "data", lambda x: F.concat(F.lit('"links":{"next":'), x, F.lit("}")))))


def feed_forum(spark, sf_dir):
    threads = spark.range(1).select(F.lit("forum").alias("source"), F.lit("all").alias("board"), F.lit(0).alias("page_no"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(
        '{"hits":[{"objectID":"1","title":"Ask: Who is hiring? (May)","created_at_i":5},{"objectID":"2","title":"Ask: Who is hiring? (June)","created_at_i":9},'
        '{"objectID":"3","title":"Who wants to be hired?","created_at_i":12}]}').alias("body"))
    line = F.concat("company", F.when(F.col("id") % 4 != 0, " | Senior Engineer").otherwise(""), F.when(F.col("id") % 5 != 0, " | Paris").otherwise(""), F.when(F.col("id") % 3 == 0, " | REMOTE").otherwise(""))
    e = _json(
        objectID=F.col("id").cast("string"), parent_id=_each(10, F.lit(2), F.lit(1)), comment_text=_each(13, F.concat(line, F.lit("<p>More &amp; more")), "  "),
        _tags=F.when(F.col("id") % 17 == 0, F.array(F.lit("comment"), F.lit("dead"))).otherwise(F.array(F.lit("comment"))), created_at=F.col("iso"))
    return shown(adapters.forum_thread(threads, payloads(base(spark, sf_dir), e, "forum", '{"hits":[', F.lit("]}")), page_size=None))


def feed_search(spark, sf_dir):
    country = F.element_at(F.array(F.lit("in"), F.lit("gb"), F.lit("zz")), (F.floor(F.col("id") / PAGE) % 3 + 1).cast("int"))
    e = _json(
        id=F.col("id").cast("string"), title=F.col("title"), company=F.struct(_each(11, F.col("company")).alias("display_name")), location=F.struct(F.lit("Pune").alias("display_name")),
        redirect_url=F.concat("link", F.lit("?app_id=1&x=2&app_key=3")), description=F.col("html"), salary_min=F.col("pay"), salary_max=_each(3, F.col("pay") * 2), salary_is_predicted=_each(5, "0", "1"), created=F.col("iso"))
    return shown(adapters.search_api(payloads(base(spark, sf_dir), e, "search", '{"results":[', F.lit("]}"), board=country), page_size=None))


def boards(spark) -> DataFrame:
    """A board per hundred ids, by its number modulo 40."""
    return spark.range(40).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("slug"), F.concat(F.lit("Board "), F.col("id").cast("string")).alias("company"))


def _board() -> Column:
    return F.concat(F.lit("b"), (F.floor(F.col("id") / PAGE) % 40).cast("string"))


def feed_board_a(spark, sf_dir):
    e = _json(
        id=F.col("id"), title=F.col("title"), absolute_url=F.col("link"), location=F.struct(_each(5, "Remote - EU").alias("name")), content=F.lit("&lt;p&gt;One&lt;/p&gt; &amp;amp; two"),
        first_published=_each(2, F.col("iso")), updated_at=F.col("iso"))
    return shown(adapters.board_a(payloads(base(spark, sf_dir), e, "a", '{"jobs":[', F.lit("]}"), board=_board()), boards(spark)))


def feed_board_b(spark, sf_dir):
    pay = F.when(F.col("id") % 3 != 0, F.struct(F.col("pay").alias("min"), (F.col("pay") * 2).alias("max"), F.lit("EUR").alias("currency")))
    e = _json(
        id=F.col("id").cast("string"), text=F.col("title"), hostedUrl=F.col("link"), categories=F.struct(F.lit("Oslo").alias("location")), workplaceType=_each(4, "Hybrid", "unspecified"),
        descriptionPlain=F.lit("plain"), createdAt=F.col("epoch") * 1000, salaryRange=pay)
    return shown(adapters.board_b(payloads(base(spark, sf_dir), e, "b", "[", F.lit("]"), board=_board()), boards(spark)))


def feed_board_c(spark, sf_dir):
    part = lambda kind, low: F.struct(F.lit(kind).alias("compensationType"), low.alias("minValue"), F.lit(None).cast("double").alias("maxValue"), F.lit("CAD").alias("currencyCode"))
    tiers = F.array(F.struct(F.array(part("Bonus", F.lit(1.0)), part("Salary", _each(6, F.col("pay"), F.lit(None).cast("double")))).alias("components")), F.struct(F.array(part("Salary", F.lit(9.0))).alias("components")))
    e = _json(
        id=F.col("id").cast("string"), title=F.col("title"), jobUrl=F.col("link"), location=F.lit("Oslo"), isListed=F.col("id") % 8 != 0, isRemote=F.col("id") % 5 == 0, workplaceType=F.lit("OnSite"),
        descriptionPlain=F.lit("plain"), publishedAt=F.col("iso"), compensation=F.struct(tiers.alias("compensationTiers")))
    return shown(adapters.board_c(payloads(base(spark, sf_dir), e, "c", '{"jobs":[', F.lit("]}"), board=_board()), boards(spark)))


def feed_union(spark, sf_dir):
    """Rows, known salaries and latest time of every source, all feeds combined."""
    rows = base(spark, sf_dir)
    a = adapters.board_a(payloads(rows, _json(id=F.col("id"), title=F.col("title"), updated_at=F.col("iso")), "a", '{"jobs":[', F.lit("]}"), board=_board()), boards(spark))
    b = adapters.board_b(payloads(rows, _json(id=F.col("id").cast("string"), createdAt=F.col("epoch") * 1000, salaryRange=F.struct(F.col("pay").alias("min"))), "b", "[", F.lit("]"), board=_board()), boards(spark))
    r = adapters.remote_list(payloads(rows, _json(id=F.col("id"), position=F.col("title"), salary_min=_each(7, F.col("pay"), 0.0)), "remote", "[", F.lit("]")))
    return adapters.combine([a, b, r]).groupBy("source").agg(F.count("*").alias("n"), F.count_if("salary_known").alias("known"), F.unix_timestamp(F.max("posted_at")).alias("last"))


def board_parse_status(spark, sf_dir):
    """Boards whose records cannot be parsed are errors, not empty successes."""
    raw = payloads(base(spark, sf_dir), _json(id=F.when(F.floor(F.col("id") / PAGE) % 40 % 5 != 0, F.col("id"))), "a", '{"jobs":[', F.lit("]}"), board=_board())
    rows = adapters.records(raw, "jobs").withColumn("ok", adapters.Fields(F.col("v")).id("id").isNotNull())
    known = [r.slug for r in boards(spark).collect()]
    return reports.observed_status(rows, known)[1].where("candidates > 0")


def board_gate(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Bad "), F.col("c_custkey").cast("string"))).otherwise(F.lower(F.regexp_replace("c_name", "#", "-"))).alias("slug"), F.col("c_name").alias("company"), "c_custkey")
    blocked = c.where("c_custkey % 5 = 0").select(F.upper(F.regexp_replace("company", "#", " # ")).alias("name"))
    return adapters.board_gate(c.drop("c_custkey"), blocked.withColumn("name", F.regexp_replace("name", " # ", "#"))).select("slug", "status")


def board_discovery(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    n = (F.col("o_orderkey") % 4).cast("int")
    items = F.to_json(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"jobs":'), items, F.lit("}"))).when(F.col("o_orderkey") % 11 == 0, F.lit("<html>")).otherwise(items)
    probes = o.select(F.col("o_custkey").cast("string").alias("slug"), kind.alias("board_type"), F.when(F.col("o_orderkey") % 5 == 0, 404).otherwise(200).alias("http_status"), body.alias("body"), "o_orderkey")
    one = probes.groupBy("slug", "board_type").agg(F.min_by(F.struct("http_status", "body"), "o_orderkey").alias("p")).select("slug", "board_type", "p.*")
    return adapters.discover_boards(one)


def source_selection(spark, sf_dir):
    """Orders of the enabled sources."""
    policy = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg((F.sum("o_totalprice") > 0).alias("any")).select("source", F.substring("source", 1, 1).isin("1", "3", "5").alias("enabled"))
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "source")
    return rows.join(adapters.select_sources(policy), "source").groupBy("source").agg(F.count("*").alias("n"))


def due_sources(spark, sf_dir, force=False):
    """Customers as sources, their latest order as the last fetch."""
    policy = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source"), (F.col("c_custkey") % 3 * 500_000).alias("min_interval_minutes"))
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    value = F.when(F.col("o_custkey") % 10 == 0, "soon").otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    state = last.select(F.concat(F.lit("last_fetch:"), F.col("o_custkey").cast("string")).alias("key"), value.alias("value"))
    return adapters.due_sources(policy, state, F.to_timestamp(F.lit("2001-08-02T00:00:00Z")), force).select("source", "due")


def due_sources_forced(spark, sf_dir):
    return due_sources(spark, sf_dir, True)


def unseen_pages(spark, sf_dir):
    """Records of a board up to its first page that is wholly stored."""
    raw = payloads(base(spark, sf_dir), _json(id=F.col("id")), "s", "[", F.lit("]"), pages=10)
    stored = base(spark, sf_dir).where(f"floor(id / {PAGE}) % 10 in (3, 6)").select(F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"))
    ident = adapters.Fields(F.col("v")).id("id")
    return adapters.unseen_pages(adapters.records(raw, None), ident, stored, 50).groupBy("board").agg(F.count("*").alias("n"), F.max("page_no").alias("last_page"))


def search_plan(spark, sf_dir):
    """Part types as roles, nations of a region as cities."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    roles = read(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("roles"))
    cities = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("country")).agg(F.array_sort(F.collect_list("n_name")).alias("cities"))
    return adapters.search_plan(cities.join(F.broadcast(roles)))


QUERIES = {f.__name__: f for f in (
    feed_remote_list, feed_category, feed_rss, feed_cursor, feed_flag, feed_forum, feed_search, feed_board_a, feed_board_b, feed_board_c, feed_union, board_parse_status, board_gate, board_discovery,
    source_selection, due_sources, due_sources_forced, unseen_pages, search_plan)}

_BASE = """WITH b AS (SELECT o_orderkey AS id, c_name AS company, o_totalprice AS pay, CAST(epoch(o_orderdate) AS BIGINT) AS posted, 'Role ' || (o_orderkey % 7) AS title,
  'https://jobs.example/' || o_orderkey AS link, 'About ' || c_name || ' & more' AS about, CAST(o_orderkey // 100 AS BIGINT) AS page FROM orders JOIN customer ON c_custkey = o_custkey) """


def _select(where: str = "", **c: str) -> str:
    given = {
        "external_id": "id::VARCHAR", "title": "title", "company": "company", "salary_min": "NULL::DOUBLE", "salary_max": "NULL::DOUBLE", "currency": "NULL::VARCHAR", "salary_known": "false",
        "salary_is_estimated": "false", "url": "link", "posted": "posted", "description": "about", "description_is_snippet": "false", **c}
    return _BASE + "SELECT " + ", ".join(f"{given[k]} AS {k}" for k in COLUMNS) + " FROM b" + where


_SHOWN = " WHERE NOT (page % 10 = 9 AND page // 10 % 2 = 0)"
ORACLE = {
    "feed_remote_list": _select(
        company="CASE WHEN id % 11 = 0 THEN 'Unknown' ELSE company END", location="CASE WHEN id % 5 = 0 THEN 'Remote' ELSE 'Paris' END",
        remote_type="CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'onsite' ELSE 'remote' END", salary_min="CASE WHEN id % 7 <> 0 THEN pay END", salary_max="CASE WHEN id % 7 <> 0 THEN pay * 2 END",
        currency="CASE WHEN id % 7 <> 0 THEN 'USD' END", salary_known="id % 7 <> 0", url="CASE WHEN id % 13 = 0 THEN 'https://apply.example/' ELSE link END"),
    "feed_category": _select(
        location="CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE 'Hybrid Berlin' END", remote_type="CASE WHEN id % 5 = 0 THEN 'remote' ELSE 'hybrid' END",
        salary_min="CASE id % 4 WHEN 0 THEN 50000.0 WHEN 2 THEN 40000.0 END::DOUBLE", salary_max="CASE id % 4 WHEN 0 THEN 60000.0 WHEN 2 THEN 40000.0 END::DOUBLE",
        currency="CASE id % 4 WHEN 0 THEN 'USD' WHEN 2 THEN 'GBP' END", salary_known="id % 2 = 0"),
    "feed_rss": _select(
        external_id="link", title="CASE WHEN id % 9 = 0 THEN company ELSE title END", company="CASE WHEN id % 9 = 0 THEN '' ELSE company END",
        location="CASE WHEN id % 3 = 0 THEN 'France' ELSE 'Anywhere' END", remote_type="'remote'", description="'One two'"),
    "feed_cursor": _select(
        _SHOWN, location="CASE WHEN id % 5 = 0 THEN 'Worldwide' ELSE 'India, Spain' END", remote_type="'remote'",
        salary_min="(coalesce(CASE WHEN id % 3 <> 0 THEN 30.0 END, CASE WHEN id % 4 <> 0 THEN 40.0 END) * CASE WHEN id % 2 = 0 THEN 1 ELSE 2080 END)::DOUBLE",
        salary_max="(coalesce(CASE WHEN id % 4 <> 0 THEN 40.0 END, CASE WHEN id % 3 <> 0 THEN 30.0 END) * CASE WHEN id % 2 = 0 THEN 1 ELSE 2080 END)::DOUBLE", currency="'USD'",
        salary_known="id % 12 <> 0"),
    "feed_flag": _select(
        _SHOWN + " AND id % 3 <> 0 AND NOT (id % 50 = 1 AND EXISTS (SELECT 1 FROM b p WHERE p.id = b.id - 1))", external_id="'s' || (id - CASE WHEN id % 50 = 1 THEN 1 ELSE 0 END)",
        location="CASE WHEN id % 5 = 0 THEN 'Remote' ELSE 'On-site Lyon' END", remote_type="CASE WHEN id % 5 = 0 THEN 'remote' ELSE 'onsite' END"),
    "feed_forum": _select(
        " WHERE id % 10 <> 0 AND id % 13 <> 0 AND id % 17 <> 0",
        title="""CASE WHEN id % 4 <> 0 THEN 'Senior Engineer' ELSE company || CASE WHEN id % 5 <> 0 THEN ' | Paris' ELSE '' END || CASE WHEN id % 3 = 0 THEN ' | REMOTE' ELSE '' END END""",
        location="""CASE WHEN id % 5 <> 0 THEN 'Paris' WHEN id % 3 = 0 THEN 'REMOTE' ELSE company || CASE WHEN id % 4 <> 0 THEN ' | Senior Engineer' ELSE '' END END""",
        remote_type="CASE WHEN id % 3 = 0 THEN 'remote' ELSE 'unknown' END", url="'https://news.ycombinator.com/item?id=' || id",
        description="""company || CASE WHEN id % 4 <> 0 THEN ' | Senior Engineer' ELSE '' END || CASE WHEN id % 5 <> 0 THEN ' | Paris' ELSE '' END || CASE WHEN id % 3 = 0 THEN ' | REMOTE' ELSE '' END || 'More & more'"""),
    "feed_search": _select(
        company="CASE WHEN id % 11 = 0 THEN 'Unknown' ELSE company END", location="'Pune'", remote_type="'unknown'",
        salary_min="CASE WHEN id % 5 <> 0 AND page % 3 < 2 AND pay >= CASE page % 3 WHEN 0 THEN 100000 ELSE 10000 END THEN pay END",
        salary_max="CASE WHEN id % 5 <> 0 AND page % 3 < 2 AND pay >= CASE page % 3 WHEN 0 THEN 100000 ELSE 10000 END THEN CASE WHEN id % 3 <> 0 THEN pay * 2 ELSE pay END END",
        currency="CASE WHEN id % 5 <> 0 AND page % 3 < 2 AND pay >= CASE page % 3 WHEN 0 THEN 100000 ELSE 10000 END THEN CASE page % 3 WHEN 0 THEN 'INR' ELSE 'GBP' END END",
        salary_known="id % 5 <> 0 AND page % 3 < 2 AND pay >= CASE page % 3 WHEN 0 THEN 100000 ELSE 10000 END", salary_is_estimated="id % 5 = 0", url="link || '?x=2'", description_is_snippet="true"),
    "feed_board_a": _select(
        company="'Board ' || page % 40", location="CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE 'Remote - EU' END", remote_type="CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'remote' END", description="'One & two'"),
    "feed_board_b": _select(
        company="'Board ' || page % 40", location="'Oslo'", remote_type="CASE WHEN id % 4 = 0 THEN 'unknown' ELSE 'hybrid' END", salary_min="CASE WHEN id % 3 <> 0 THEN pay END",
        salary_max="CASE WHEN id % 3 <> 0 THEN pay * 2 END", currency="CASE WHEN id % 3 <> 0 THEN 'EUR' END", salary_known="id % 3 <> 0", description="'plain'"),
    "feed_board_c": _select(
        " WHERE id % 8 <> 0", company="'Board ' || page % 40", location="'Oslo'", remote_type="CASE WHEN id % 5 = 0 THEN 'remote' ELSE 'onsite' END",
        salary_min="CASE WHEN id % 6 <> 0 THEN pay ELSE 9.0::DOUBLE END", currency="'CAD'", salary_known="true", description="'plain'"),
    "feed_union": _BASE + """SELECT 'a' AS source, count(*) AS n, 0::BIGINT AS known, max(posted) AS last FROM b UNION ALL SELECT 'b', count(*), count(*), max(posted) FROM b
        UNION ALL SELECT 'remote', count(*), count(*) FILTER (id % 7 <> 0), NULL FROM b""",
    "board_parse_status": _BASE + """SELECT 'b' || page % 40 AS board, count(*) AS candidates, count(*) FILTER (page % 40 % 5 <> 0) AS parsed, CASE WHEN page % 40 % 5 = 0 THEN 'error' ELSE 'ok' END AS status
        FROM b GROUP BY page % 40""",
    "board_gate": """SELECT CASE WHEN c_custkey % 7 = 0 THEN 'Bad ' || c_custkey ELSE lower(replace(c_name, '#', '-')) END AS slug,
        CASE WHEN c_custkey % 7 = 0 THEN 'error' WHEN c_custkey % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status FROM customer""",
    "board_discovery": """WITH p AS (SELECT o_custkey, o_orderkey % 3 AS t, arg_min(o_orderkey, o_orderkey) AS k FROM orders GROUP BY 1, 2),
        g AS (SELECT o_custkey, t, k FROM p WHERE k % 5 <> 0 AND (k % 3 = 0 OR k % 11 <> 0))
        SELECT s.o_custkey::VARCHAR AS slug, ['A', 'B', 'C'][min(t) + 1] AS board_type, CAST(arg_min(k, t) % 4 AS INTEGER) AS jobs FROM (SELECT DISTINCT o_custkey FROM orders) s LEFT JOIN g USING (o_custkey) GROUP BY s.o_custkey""",
    "source_selection": "SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '3', '5') GROUP BY 1",
    "due_sources": """SELECT c_custkey::VARCHAR AS source, coalesce(c_custkey % 10 = 0 OR fetched IS NULL OR date_diff('second', fetched, TIMESTAMP '2001-08-02') >= c_custkey % 3 * 500000 * 60, true) AS due
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS fetched FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "due_sources_forced": "SELECT c_custkey::VARCHAR AS source, true AS due FROM customer",
    "unseen_pages": _BASE + """SELECT (page // 10)::VARCHAR AS board, count(*) FILTER (page % 10 <= 3) AS n, CAST(max(page % 10) FILTER (page % 10 <= 3) AS INTEGER) AS last_page FROM b GROUP BY 1""",
    "search_plan": """SELECT r_name AS country, p_type AS role, n_name AS city, CAST(row_number() OVER (PARTITION BY r_name ORDER BY p_type, n_name) AS INTEGER) AS rank
        FROM (SELECT DISTINCT p_type FROM part), nation JOIN region ON n_regionkey = r_regionkey""",
}
