"""Feed adapters: raw payload rows to postings.

Input: raw(source, board, page_no, fetched_at, body).  Every adapter is a
projection; fields are read by type-checked accessors that give null instead
of failing.  One schema comes out, so adapters combine with ``unionByName``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.money import PAY_PERIODS, parse_salary
from millrace.functions.web import drop_query_keys, remote_type

POSTING = (
    "source string, external_id string, title string, company string, location string, remote_type string, salary_min double, salary_max double, currency string, "
    "salary_known boolean, salary_is_estimated boolean, url string, posted_at timestamp, description string, description_is_snippet boolean")


class Fields:
    """Null-safe typed access to an object held as a variant."""

    def __init__(self, v: Column):
        self.v = v

    def any(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(self.any(path))

    def string(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, f"$.{path}", "string"))

    def number(self, path: str) -> Column:
        return F.when(self.kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(self.v, f"$.{path}", "double"))

    def flag(self, path: str) -> Column:
        return F.when(self.kind(path) == "BOOLEAN", F.try_variant_get(self.v, f"$.{path}", "boolean"))

    def id(self, path: str) -> Column:
        """A number, or a trimmed non-empty string."""
        whole = F.when(self.kind(path).rlike("^(BIGINT|DECIMAL)"), F.try_variant_get(self.v, f"$.{path}", "long").cast("string"))
        return F.coalesce(whole, F.nullif(F.trim(self.string(path)), F.lit("")))

    def strings(self, path: str) -> Column:
        raw = F.try_variant_get(self.v, f"$.{path}", "array<variant>")
        return F.coalesce(F.transform(F.filter(raw, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def records(raw: DataFrame, root: str | None) -> DataFrame:
    """One row per element of a root array (``root`` None) or of a field; pages
    keep their order in pos.  A page is parsed once and becomes rows by a lateral
    table function; one that is no array there has none."""
    page = F.try_variant_get(F.try_parse_json("body"), "$" if root is None else f"$.{root}", "variant")
    whole = raw.select("source", "board", "page_no", "fetched_at", page.alias("_page"))
    parts = raw.sparkSession.tvf.variant_explode(F.when(F.schema_of_variant(F.col("_page").outer()).startswith("ARRAY"), F.col("_page").outer()))
    return whole.lateralJoin(parts).select("source", "board", "page_no", "fetched_at", "pos", F.col("value").alias("v"))


def until_stop(pages: DataFrame, stop: Column, max_pages: int | None) -> DataFrame:
    """Pages of each source and board up to and including the first that stops,
    at most ``max_pages`` from the first one on (None: as many as there are).

    The first stop is a minimum, found map-side over narrow rows, so that page
    bodies are neither sorted nor shuffled for it."""
    ends = pages.groupBy("source", "board").agg(F.min(F.when(stop, F.col("page_no"))).alias("_stop"), F.min("page_no").alias("_first"))
    last = F.col("_stop") if max_pages is None else F.least(F.col("_stop"), F.col("_first") + max_pages - 1)
    keys = ends.select(F.col("source").alias("_source"), F.col("board").alias("_board"), last.alias("_last"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("board").eqNullSafe(F.col("_board"))
    return pages.join(keys, same).where("_last is null or page_no <= _last").drop("_source", "_board", "_last")


def short_page(root: str, size: int) -> Column:
    """Whether a page holds fewer than ``size`` records; one without a list is short."""
    n = F.size(F.try_variant_get(F.try_parse_json("body"), f"$.{root}", "array<variant>"))
    return F.coalesce(n, F.lit(0)) < size


def until_short(pages: DataFrame, root: str, page_size: int | None, max_pages: int | None) -> DataFrame:
    """Pages up to the first short one, at most ``max_pages``; without a page size
    a short page ends nothing, and without either all pages are read as they are."""
    if page_size is None and max_pages is None:
        return pages
    return until_stop(pages, F.lit(False) if page_size is None else short_page(root, page_size), max_pages)


def first_of_id(rows: DataFrame, ident: Column) -> DataFrame:
    """Records of a source in page order, each id once; rows without id go."""
    named = rows.withColumn("_id", ident).where("_id is not null")
    whole = F.struct("source", "board", "page_no", "fetched_at", "pos", "v")
    return named.groupBy(F.col("source").alias("_source"), "_id").agg(F.min_by(whole, F.struct("page_no", "board", "pos")).alias("r")).select("r.*")


def unseen_pages(rows: DataFrame, ident: Column, stored: DataFrame, max_pages: int) -> DataFrame:
    """Records of each source and board up to and including the first page whose
    records are all stored (source, external_id) already."""
    known = stored.select("source", F.col("external_id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    marked = rows.withColumn("_id", ident).join(known, ["source", "_id"], "left")
    full = marked.groupBy("source", "board", "page_no").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_full"))
    kept = until_stop(full, F.col("_full"), max_pages).select("source", "board", "page_no")
    return marked.join(kept, ["source", "board", "page_no"]).drop("_id", "_known").select(*rows.columns)


def search_plan(settings: DataFrame) -> DataFrame:
    """(country, role, city, rank): every search of each row of settings (country,
    roles, cities), role by role.  Two explodes of rule lists, no join."""
    roles = settings.select("country", F.posexplode("roles").alias("r", "role"), "cities")
    pairs = roles.select("country", "role", "r", F.size("cities").alias("n"), F.posexplode("cities").alias("c", "city"))
    return pairs.select("country", "role", "city", (F.col("r") * F.col("n") + F.col("c") + 1).alias("rank"))


def due_sources(policy: DataFrame, app_state: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """``policy`` (source, min_interval_minutes) plus due: a source fetched less
    than its interval before ``now`` is skipped unless forced; without a time, or
    with one that cannot be read, it runs.  app_state: (key, value)."""
    last = app_state.select(F.regexp_replace("key", "^last_fetch:", "").alias("source"), F.try_to_timestamp("value").alias("_last"))
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("_last")
    due = F.coalesce(elapsed >= F.col("min_interval_minutes") * 60, F.lit(True)) if not force else F.lit(True)
    return policy.join(last, "source", "left").withColumn("due", due).drop("_last")


def posting(source: Column, **c: Column) -> list[Column]:
    """The standard columns from what an adapter gives; the rest is null."""
    given = {"source": source, "salary_is_estimated": F.lit(False), "description_is_snippet": F.lit(False), **c}
    low, high = given.get("salary_min", F.lit(None)), given.get("salary_max", F.lit(None))
    given.setdefault("salary_known", low.isNotNull() | high.isNotNull())
    return [given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.strip().split(" ") for x in POSTING.split(", "))]


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def remote_list(raw: DataFrame) -> DataFrame:
    """Array root; the legal-notice row goes; dollars iff a salary is given; the
    time is a text, else epoch seconds."""
    f = Fields(F.col("v"))
    low, high = _positive(f.number("salary_min")), _positive(f.number("salary_max"))
    rows = records(raw, None).where(f.id("id").isNotNull() & f.string("position").isNotNull())
    place = F.coalesce(F.nullif(F.trim(f.string("location")), F.lit("")), F.lit("Remote"))
    return rows.select(*posting(
        F.col("source"), external_id=f.id("id"), title=F.trim(f.string("position")), company=F.coalesce(f.string("company"), F.lit("Unknown")), location=place,
        remote_type=remote_type(place, F.concat_ws(" ", f.strings("tags")), "remote"), salary_min=low, salary_max=high, currency=F.when(F.coalesce(low, high).isNotNull(), "USD"),
        url=F.coalesce(f.string("url"), f.string("apply_url")), posted_at=F.coalesce(_time(f.string("date")), F.timestamp_seconds(f.number("epoch"))), description=X.html_to_text(F.coalesce(f.string("description"), F.lit("")))))


def category_feed(raw: DataFrame) -> DataFrame:
    """Object with jobs; free-text salary; times without zone are UTC."""
    f = Fields(F.col("v"))
    at, pay = f.string("publication_date"), parse_salary(F.coalesce(f.string("salary"), F.lit("")))
    zoned = at.endswith("Z") | at.contains("+") | (F.length(at) - F.length(F.substring_index(at, "-", -1)) > 10)
    place = F.coalesce(f.string("candidate_required_location"), F.lit("Unknown"))
    return records(raw, "jobs").where(f.id("id").isNotNull()).select("*", pay.alias("pay")).select(*posting(
        F.col("source"), external_id=f.id("id"), title=f.string("title"), company=f.string("company_name"), location=place, remote_type=remote_type(place, F.concat_ws(" ", f.strings("tags")), "remote"),
        salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), currency=F.col("pay.currency"), salary_known=F.col("pay.known"), url=f.string("url"),
        posted_at=_time(F.when(zoned, at).otherwise(F.concat(at, F.lit("Z")))), description=X.html_to_text(F.coalesce(f.string("description"), F.lit("")))))


def rss_feed(raw: DataFrame) -> DataFrame:
    """RSS bodies; "Company: Title" is split at the first ": ", items without
    title or link go."""
    item = "array<struct<title:string,link:string,guid:string,region:string,country:string,description:string,pubDate:string>>"
    items = F.expr(f"from_xml(body, 'channel struct<item:{item}>', map('rowTag', 'rss'))")
    rows = raw.select("source", F.posexplode(items["channel"]["item"]).alias("pos", "i")).where(F.col("i.title").isNotNull() & F.col("i.link").isNotNull())
    title, at = F.col("i.title"), F.regexp_replace("i.pubDate", r"^[A-Za-z]{3}, ", "")
    split = F.locate(": ", title)
    place = F.coalesce("i.region", "i.country", F.lit("Unknown"))
    return rows.select(*posting(
        F.col("source"), external_id=F.coalesce("i.guid", "i.link"), title=F.when(split > 0, F.substring(title, split + 2, F.length(title))).otherwise(title),
        company=F.when(split > 0, F.substring(title, F.lit(1), split - 1)).otherwise(""), location=place, remote_type=remote_type(place, F.lit(""), "remote"), url=F.col("i.link"),
        posted_at=F.try_to_timestamp(at, F.lit("dd MMM yyyy HH:mm:ss Z")), description=X.html_to_text(F.coalesce("i.description", F.lit("")))))


def cursor_feed(raw: DataFrame, max_pages: int = 50) -> DataFrame:
    """Pages until the cursor is empty; pay is made yearly by its period, a
    missing bound takes the other's value."""
    pages = until_stop(raw, F.coalesce(Fields(F.try_parse_json("body")).string("nextCursor"), F.lit("")) == "", max_pages)
    f = Fields(F.col("v"))
    factor = F.create_map(*[x for k, v in PAY_PERIODS.items() for x in (F.lit(k), F.lit(float(v)))])
    times = F.try_element_at(factor, F.lower(F.coalesce(f.string("salaryPeriod"), F.lit("annual"))))
    low, high = f.number("minSalary") * times, f.number("maxSalary") * times
    place = F.coalesce(F.nullif(F.array_join(f.strings("locationRestrictions"), ", "), F.lit("")), F.lit("Worldwide"))
    return records(pages, "jobs").where(f.id("guid").isNotNull()).select(*posting(
        F.col("source"), external_id=f.id("guid"), title=f.string("title"), company=f.string("companyName"), location=place, remote_type=F.lit("remote"), salary_min=F.coalesce(low, high),
        salary_max=F.coalesce(high, low), currency=f.string("currency"), url=f.string("applicationLink"), posted_at=F.timestamp_seconds(f.number("pubDate")), description=X.html_to_text(F.coalesce(f.string("description"), F.lit("")))))


def flag_feed(raw: DataFrame, max_pages: int = 50) -> DataFrame:
    """Pages until there is no next link; only rows with remote = true, the first
    of an id."""
    pages = until_stop(raw, Fields(F.try_parse_json("body")).string("links.next").isNull(), max_pages)
    f = Fields(F.col("v"))
    place = F.coalesce(f.string("location"), F.lit("Remote"))
    return first_of_id(records(pages, "data"), f.id("slug")).where(f.flag("remote") & f.id("slug").isNotNull()).select(*posting(
        F.col("source"), external_id=f.id("slug"), title=f.string("title"), company=f.string("company_name"), location=place, remote_type=remote_type(place, F.concat_ws(" ", f.strings("tags")), "remote"), url=f.string("url"),
        posted_at=F.timestamp_seconds(f.number("created_at")), description=X.html_to_text(F.coalesce(f.string("description"), F.lit("")))))


# Words that mark a role or a place in a headline.
ROLE_WORDS = (
    "engineer", "developer", "programmer", "architect", "manager", "lead", "designer", "scientist", "analyst", "director", "recruiter", "founder", "principal", "staff", "devops", "sre",
    "consultant", "specialist")
CITIES = (
    "bangalore", "bengaluru", "london", "paris", "berlin", "tokyo", "new york", "dublin", "singapore", "dubai", "amsterdam", "toronto", "sydney", "seattle", "san francisco", "austin",
    "boston", "chicago", "munich", "stockholm", "lisbon", "barcelona", "madrid", "zurich", "hyderabad", "pune", "delhi", "mumbai")


def headline(text: Column, cities: list[str] | None = None) -> Column:
    """struct(company, title, location, headline) of a comment's first line."""
    line = F.trim(X.html_to_text(F.regexp_replace(F.split(text, "\n")[0], "(?s)<.*$", ""), None))
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    first = F.trim(F.split(line, r"\|")[0])
    has = lambda s, words: F.greatest(*[F.lower(s).contains(w) for w in words])
    pick = lambda words: F.try_element_at(F.filter(parts, lambda s: has(s, words)), F.lit(1))
    places = ["remote", "onsite", "on-site", "hybrid", *CITIES, *[c.lower() for c in cities or [] if c]]
    return F.struct(
        F.when(first == "", "Unknown").otherwise(first).alias("company"), F.coalesce(pick(ROLE_WORDS), F.substring(line, 1, 120)).alias("title"),
        F.coalesce(pick(places), F.when(line == "", "Unknown").otherwise(line)).alias("location"), line.alias("headline"))


def forum_thread(threads: DataFrame, comments: DataFrame, cities: list[str] | None = None, max_pages: int | None = None, page_size: int | None = 100) -> DataFrame:
    """Top-level comments of the latest hiring thread, from the pages up to the
    first short one; a bound on pages is a source's own policy."""
    f = Fields(F.col("v"))
    title = F.lower(f.string("title"))
    hiring = title.contains("who is hiring") & ~title.contains("wants to be hired") & ~title.contains("freelancer")
    story = records(threads, "hits").where(hiring).agg(F.max_by(f.id("objectID"), F.struct(f.number("created_at_i"), -F.col("pos"))).alias("story"))
    text = F.coalesce(f.string("comment_text"), F.lit(""))
    rows = records(until_short(comments, "hits", page_size, max_pages), "hits").withColumn("parent", f.id("parent_id")).join(F.broadcast(story), F.col("parent") == F.col("story")).where((F.trim(text) != "") & ~F.arrays_overlap(f.strings("_tags"), F.array(F.lit("deleted"), F.lit("dead"))))
    rows = rows.withColumn("h", headline(text, cities))
    return rows.select(*posting(
        F.col("source"), external_id=f.id("objectID"), title=F.col("h.title"), company=F.col("h.company"), location=F.col("h.location"), remote_type=remote_type(F.col("h.headline"), F.lit(""), "unknown"),
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), f.id("objectID")), posted_at=_time(f.string("created_at")), description=X.html_to_text(text)))


def search_api(raw: DataFrame, currencies: dict[str, str] | None = None, max_pages: int | None = None, page_size: int | None = 50) -> DataFrame:
    """``board`` is the country; predicted pay is unknown and estimated, pay
    under the plausible floor unknown; credentials leave the URL.  A search ends
    with its first short page; a bound on pages is a source's own policy."""
    f = Fields(F.col("v"))
    table = currencies or {"in": "INR", "gb": "GBP", "us": "USD", "de": "EUR", "fr": "EUR", "ca": "CAD", "au": "AUD", "sg": "SGD"}
    currency = F.try_element_at(F.create_map(*[x for kv in table.items() for x in map(F.lit, kv)]), F.lower("board"))
    low, high = f.number("salary_min"), f.number("salary_max")
    predicted = F.coalesce((f.string("salary_is_predicted") == "1") | (f.number("salary_is_predicted") == 1) | f.flag("salary_is_predicted"), f.string("salary_is_predicted") == "1", F.lit(False))
    floor = F.when(currency == "INR", 100_000.0).otherwise(10_000.0)
    paid = F.coalesce((~predicted) & (F.least(F.coalesce(low, high), F.coalesce(high, low)) >= floor) & currency.isNotNull(), F.lit(False))
    place = F.coalesce(f.string("location.display_name"), F.lit("Unknown"))
    return records(until_short(raw, "results", page_size, max_pages), "results").where(f.id("id").isNotNull()).select(*posting(
        F.col("source"), external_id=f.id("id"), title=f.string("title"), company=F.coalesce(f.string("company.display_name"), F.lit("Unknown")), location=place, remote_type=remote_type(place, F.lit(""), "unknown"),
        salary_min=F.when(paid, F.coalesce(low, high)), salary_max=F.when(paid, F.coalesce(high, low)), currency=F.when(paid, currency), salary_known=paid, salary_is_estimated=predicted,
        url=drop_query_keys(f.string("redirect_url"), ["app_id", "app_key"]), posted_at=_time(f.string("created")), description=X.html_to_text(F.coalesce(f.string("description"), F.lit(""))), description_is_snippet=F.lit(True)))


def board_a(raw: DataFrame, boards: DataFrame) -> DataFrame:
    """Object with jobs; the company comes from the board row."""
    f = Fields(F.col("v"))
    place = F.coalesce(f.string("location.name"), F.lit("Unknown"))
    return records(raw, "jobs").where(f.id("id").isNotNull()).join(boards.select(F.col("slug").alias("board"), F.col("company").alias("_company")), "board").select(*posting(
        F.col("source"), external_id=f.id("id"), title=f.string("title"), company=F.col("_company"), location=place, remote_type=remote_type(place, F.lit(""), "unknown"), url=f.string("absolute_url"),
        posted_at=F.coalesce(_time(f.string("first_published")), _time(f.string("updated_at"))), description=X.html_to_text(F.coalesce(f.string("content"), F.lit("")))))


def board_b(raw: DataFrame, boards: DataFrame) -> DataFrame:
    """Array root; epoch milliseconds as number or digits."""
    f = Fields(F.col("v"))
    place, kind = F.coalesce(f.string("categories.location"), F.lit("Unknown")), F.lower(F.trim(f.string("workplaceType")))
    millis = F.coalesce(f.number("createdAt"), f.string("createdAt").try_cast("double")).cast("long")
    return records(raw, None).where(f.id("id").isNotNull()).join(boards.select(F.col("slug").alias("board"), F.col("company").alias("_company")), "board").select(*posting(
        F.col("source"), external_id=f.id("id"), title=f.string("text"), company=F.col("_company"), location=place, remote_type=F.when(kind.isin("remote", "hybrid", "onsite"), kind).otherwise(remote_type(place, F.lit(""), "unknown")),
        salary_min=f.number("salaryRange.min"), salary_max=f.number("salaryRange.max"), currency=f.string("salaryRange.currency"), url=f.string("hostedUrl"), posted_at=F.timestamp_millis(millis), description=f.string("descriptionPlain")))


def board_c(raw: DataFrame, boards: DataFrame) -> DataFrame:
    """Listed jobs only; pay is the first salary (or untyped) component with a
    bound, in tier order."""
    f = Fields(F.col("v"))
    tiers = F.from_json(F.to_json(f.any("compensation.compensationTiers")), "array<struct<components:array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string>>>>")
    parts = F.flatten(F.transform(tiers, lambda t: t["components"]))
    pay = F.try_element_at(F.filter(parts, lambda c: (F.coalesce(F.lower(c["compensationType"]), F.lit("salary")) == "salary") & (c["minValue"].isNotNull() | c["maxValue"].isNotNull())), F.lit(1))
    place, kind = F.coalesce(f.string("location"), F.lit("Unknown")), F.lower(F.trim(f.string("workplaceType")))
    rows = records(raw, "jobs").where(f.id("id").isNotNull() & F.coalesce(f.flag("isListed"), F.lit(True))).withColumn("pay", pay)
    return rows.join(boards.select(F.col("slug").alias("board"), F.col("company").alias("_company")), "board").select(*posting(
        F.col("source"), external_id=f.id("id"), title=f.string("title"), company=F.col("_company"), location=place,
        remote_type=F.when(f.flag("isRemote"), "remote").when(kind.isin("remote", "hybrid", "onsite"), kind).otherwise(remote_type(place, F.lit(""), "unknown")),
        salary_min=F.col("pay.minValue"), salary_max=F.col("pay.maxValue"), currency=F.col("pay.currencyCode"), url=f.string("jobUrl"), posted_at=_time(f.string("publishedAt")), description=f.string("descriptionPlain")))


SLUG = r"^[a-z0-9][a-z0-9_-]{0,63}$"


def board_gate(boards: DataFrame, blocked: DataFrame) -> DataFrame:
    """``boards`` plus status: error for a bad slug, skipped for a blocked company."""
    bad = blocked.select(X.normalise_company(F.col("name")).alias("_key")).distinct().withColumn("_blocked", F.lit(True))
    out = boards.withColumn("_key", X.normalise_company(F.col("company"))).join(bad, "_key", "left")
    return out.withColumn("status", F.when(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)), "error").when(F.col("_blocked"), "skipped").otherwise("ok")).drop("_key", "_blocked")


def discover_boards(probes: DataFrame, order: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """(slug, board_type, jobs): the first type in order whose probe (slug,
    board_type, http_status, body) is 2xx and holds a countable list."""
    n = F.coalesce(F.json_array_length("body"), F.json_array_length(F.get_json_object("body", "$.jobs")))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("board_type"))
    good = probes.where(F.col("http_status").between(200, 299) & n.isNotNull() & (place > 0))
    best = good.groupBy("slug").agg(F.min_by(F.struct("board_type", n.alias("jobs")), place).alias("b"))
    return probes.select("slug").distinct().join(best, "slug", "left").select("slug", F.col("b.board_type").alias("board_type"), F.col("b.jobs").alias("jobs"))


def select_sources(policy: DataFrame, only: str | None = None) -> DataFrame:
    """All enabled sources, or the named one; an unknown name raises."""
    if only is None:
        return policy.where("enabled")
    out = policy.where(F.col("source") == only)
    if out.isEmpty():
        raise ValueError(f"unknown source: {only}")
    return out


def combine(adapted: list[DataFrame]) -> DataFrame:
    """All postings; adapters never fail a whole run, bad rows are absent."""
    out = adapted[0]
    for df in adapted[1:]:
        out = out.unionByName(df)
    return out


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "remote_list": remote_list, "category_feed": category_feed, "rss_feed": rss_feed, "cursor_feed": cursor_feed, "flag_feed": flag_feed, "search_api": search_api,
    "board_a": board_a, "board_b": board_b, "board_c": board_c, "forum_thread": forum_thread}
