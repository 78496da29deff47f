"""Text and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.web import url_rejection
from millrace.operators import automaton, grounding, redact, vocab
from millrace.runtime import read, spread


def html_to_text(spark, sf_dir):
    t = X.html_to_text(F.col("html"), None)
    return spread(read(spark, sf_dir, "pages")).select("page_id", F.length(t).alias("n_chars"), F.md5(t).alias("text_md5"))


def url_check(spark, sf_dir):
    hosts = F.array(F.lit("thther.example.org"), F.lit("blog.tionsh.example.net"))
    mode = F.when(F.col("page_id") % 3 == 0, "any-https").when(F.col("page_id") % 3 == 1, "hosts")
    return spread(read(spark, sf_dir, "pages")).select("page_id", url_rejection(F.col("url"), mode, hosts).alias("rejection"))


def pii_counts(spark, sf_dir):
    rows = redact.redact(spread(read(spark, sf_dir, "documents")).select("doc_id", "text"))
    return rows.agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in redact.KINDS], F.count_if(F.col("redacted") != F.col("text")).alias("changed"))


def pii_values(spark, sf_dir):
    """Redaction with listed values: persons named by the first two words of each
    item."""
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([0-9A-Za-z]+)"), F.lit(1)), 1, 2), " ")
    values = read(spark, sf_dir, "benchmark").select(F.lit("name").alias("kind"), words.alias("value"))
    rows = redact.redact(spread(read(spark, sf_dir, "documents")).select("doc_id", "text"), values=values)
    return rows.select("doc_id", *[f"n_{k}" for k in redact.KINDS], F.md5("redacted").alias("redacted_md5"))


def email_counts(spark, sf_dir):
    n = F.size(F.regexp_extract_all("text", F.lit(redact.EMAIL), F.lit(0)))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", n.alias("n_email"))


def pii_leaks_after_redaction(spark, sf_dir):
    rows = redact.redact(spread(read(spark, sf_dir, "documents")).select("doc_id", "text"))
    return rows.select(F.explode(redact.leaks(F.col("redacted"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def address_lines(spark, sf_dir):
    t = redact.redact_address_lines(F.col("text"))
    return spread(read(spark, sf_dir, "documents")).agg(F.count("*").alias("n"), F.sum((t != F.col("text")).cast("long")).alias("changed"))


def secret_scrub(spark, sf_dir):
    t = X.scrub_secrets(F.col("text"))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.md5(t).alias("text_md5"))


def numbers_per_doc(spark, sf_dir):
    n = X.numbers(F.col("text"))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.size(n).alias("n"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def phrase_filter(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).where(X.contains_any(F.col("text"), ["license", "the apache", "copyright"])).select("doc_id", "lang")


def normalised_words(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).select("doc_id", X.word_count(F.col("text")).alias("n_words"), F.md5(X.normalise(F.col("text"))).alias("norm_md5"))


def passages(docs, items):
    """(doc_id, item_id) of items (item_id, e) whose whole text stands in a
    document (doc_id, t).  The second to fourth word of an item are whole words of
    the document too and make the join key; items of fewer than five words are
    looked for in all documents at once, by an automaton in bounded parts."""
    words = F.split("e", " ")
    keyed = items.withColumn("k", F.when(F.size(words) >= 5, F.array_join(F.slice(words, 2, 3), " ")))
    runs = F.transform(F.array(F.split("t", " ")), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, 3), " ")))[0]
    pairs = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("k")).join(keyed.where("k is not null"), "k").select("doc_id", "item_id", "e").distinct()
    long = pairs.join(docs, "doc_id").where(F.contains("t", "e")).select("doc_id", "item_id")
    short = keyed.where("k is null and e <> ''").select("item_id", "e", F.length("e").alias("n"))
    found = automaton.search(docs.select("doc_id", "t"), short, "n", contained, "item_id bigint").select("doc_id", F.explode("found.item_id").alias("item_id"))
    return long.unionByName(found).distinct()


def contained(items):
    """Of some items those whose text stands in a text."""
    by_text = {}
    for x in items:
        by_text.setdefault(x["e"], []).append({"item_id": x["item_id"]})
    machine, groups = automaton.build(list(by_text)), list(by_text.values())
    return lambda t: [x for i in sorted({i for _, _, i in automaton.hits(machine, t)}) for x in groups[i]]


def excerpt_search(spark, sf_dir):
    """Benchmark items whose whole text stands in a document."""
    items = read(spark, sf_dir, "benchmark").select("item_id", X.normalise_excerpt(F.col("text")).alias("e"))
    return passages(spread(read(spark, sf_dir, "documents")).select("doc_id", X.normalise_excerpt(F.col("text")).alias("t")), items)


def sections_of_doc(spark, sf_dir):
    return grounding.sections(spread(read(spark, sf_dir, "documents")).select("doc_id", "text")).select("doc_id", "section", F.md5("text").alias("text_md5"))


VOCABULARY = ("# names", "Apache License|apache licence", "=The", "in the", "la de|de la", "und|der die")


def vocabulary_lines(spark, sf_dir):
    """(ord, value): names from the first three words of every item, and a few more."""
    words = F.regexp_extract_all("text", F.lit("([0-9A-Za-z]+)"), F.lit(1))
    names = F.concat_ws("|", *[F.array_join(F.slice(words, i, n), " ") for i, n in ((1, 3), (1, 2), (2, 2))])
    fixed = spark.createDataFrame([(i - len(VOCABULARY), x) for i, x in enumerate(VOCABULARY)], "ord long, value string")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), names.alias("value")).unionByName(fixed)


def vocabulary_terms(spark, sf_dir):
    names = vocab.read_vocabulary(vocabulary_lines(spark, sf_dir), order="ord")
    return vocab.find_terms(spread(read(spark, sf_dir, "documents")), names).select("doc_id", F.array_join("terms", ",").alias("terms"))


def letter_rule_codes(spark, sf_dir):
    """Problem codes of assistant turns read as letters."""
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select(F.explode(grounding.letter_codes(F.col("text"), domain_terms=["the", "der"], technologies=["la", "and"])).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    html_to_text, url_check, pii_counts, pii_values, email_counts, pii_leaks_after_redaction, address_lines, secret_scrub, numbers_per_doc, phrase_filter, normalised_words, excerpt_search, sections_of_doc,
    vocabulary_terms, letter_rule_codes)}

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))"
_SCRUBBED = "text"
for _pattern, _to in X.SECRET_SHAPES:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern}', '{_to.replace('$', chr(92))}', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SHAPES = [("email", redact.SHAPED_EMAIL, redact.EMAIL)] + [("url", redact.SHAPED_URL, "(?i)" + p) for p in redact.URL_SHAPES] + [("phone", redact.SHAPED_PHONE, p) for p in redact.PHONE_SHAPES]


def _spans_sql(docs: str, x: str, more: str = "") -> str:
    """CTEs over ``docs`` (r, text): spans by shape and ``more`` of them (r, kind,
    place, s, e), resolved as ``{x}kept``; names start with ``x``."""
    found = " UNION ALL ".join(f"""SELECT r, text, '{kind}' AS kind, {place} AS place, {i} AS shape, unnest(range(1, len(regexp_extract_all(text, {_quoted(p)})) + 1)) AS i,
          unnest(string_split_regex(text, {_quoted(p)})[:len(regexp_extract_all(text, {_quoted(p)}))]) AS b, unnest(regexp_extract_all(text, {_quoted(p)})) AS m FROM {docs} WHERE regexp_matches(text, {_quoted(p)})""" for i, (kind, place, p) in enumerate(_SHAPES))
    dates = "|".join(redact.DATE_SHAPES)
    return f"""{x}found AS ({found}),
        {x}placed AS (SELECT *, sum(length(b)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM {x}found WINDOW w AS (PARTITION BY r, shape ORDER BY i ROWS UNBOUNDED PRECEDING)),
        {x}ended AS (SELECT r, text, kind, place, s, s + length(CASE WHEN kind = 'url' THEN regexp_replace(m, {_quoted(redact.URL_END)}, '') ELSE m END) AS e, trim(m) AS m FROM {x}placed),
        {x}ok AS (SELECT r, kind, place, s, e FROM (SELECT *, substr(text, greatest(s - 7, 1)::BIGINT, least(s, 8)::BIGINT) AS head, substr(text, (e + 1)::BIGINT) AS tail FROM {x}ended) WHERE e > s AND (kind <> 'phone' OR (
            length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(head, '[0-9]$') AND NOT regexp_matches(tail, '^[0-9]') AND NOT regexp_matches(tail, '(?i){redact.METRIC}')
            AND NOT regexp_matches(head, '(?i){redact.AMOUNT}') AND NOT regexp_matches(m, '{dates}') AND NOT (regexp_matches(m, '{redact.YEAR}') AND regexp_matches(m, '[/-]')) AND NOT regexp_matches(m, '{redact.VERSION}'))) {more}),
        {x}edges AS (SELECT *, s >= coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS apart FROM {x}ok),
        {x}ranked AS (SELECT *, row_number() OVER (PARTITION BY r, g ORDER BY s, e DESC, place, kind) AS k FROM (SELECT *, sum(apart::INT) OVER (PARTITION BY r ORDER BY s, e DESC, place ROWS UNBOUNDED PRECEDING) AS g FROM {x}edges)),
        {x}folded AS (
          SELECT r, g, k, s, e, kind, true AS kept, e AS at FROM {x}ranked WHERE k = 1
          UNION ALL
          SELECT f.r, f.g, h.k, h.s, h.e, h.kind, h.s >= f.at, CASE WHEN h.s >= f.at THEN h.e ELSE f.at END FROM {x}folded f JOIN {x}ranked h ON h.r = f.r AND h.g = f.g AND h.k = f.k + 1),
        {x}kept AS (SELECT r, s, e, kind FROM {x}folded WHERE kept)"""


_PLACES = "|".join(redact.PLACES)
_IS_ADDRESS = rf"(regexp_matches(x, '(?i){redact.ADDRESS_WORD}') OR regexp_matches(x, '(?i)\b\d{{6}}\b[\s,.-]{{0,3}}({_PLACES})\b|\b({_PLACES})\b[\s,.-]{{0,3}}\d{{6}}\b'))"
_IS_PLACEHOLDERS = rf"(regexp_matches(x, '{redact.PLACEHOLDER}') AND regexp_replace(regexp_replace(x, '{redact.PLACEHOLDER}', '', 'g'), '{redact.SEPARATORS}', '', 'g') = '')"


def _redacted_sql(docs: str, x: str, more: str = "") -> str:
    """CTEs as above, and ``{x}done`` (r, redacted, n_address of lines)."""
    return f"""{_spans_sql(docs, x, more)},
        {x}cut AS (SELECT k.*, substr(d.text, (coalesce(lag(e) OVER w, 0) + 1)::BIGINT, (s - coalesce(lag(e) OVER w, 0))::BIGINT) AS before FROM {x}kept k JOIN {docs} d USING (r) WINDOW w AS (PARTITION BY r ORDER BY s)),
        {x}put AS (SELECT r, string_agg(before || '[' || upper(kind) || ']', '' ORDER BY s) AS front, max(e) AS at FROM {x}cut GROUP BY r),
        {x}lines AS (SELECT r, string_split(coalesce(p.front, '') || substr(d.text, (coalesce(p.at, 0) + 1)::BIGINT), chr(10)) AS ls FROM {docs} d LEFT JOIN {x}put p USING (r)),
        {x}done AS (SELECT r, len(list_filter(ls, lambda x: {_IS_ADDRESS} AND NOT {_IS_PLACEHOLDERS})) AS n_lines,
          array_to_string(list_filter(list_transform(ls, lambda x: CASE WHEN {_IS_ADDRESS} AND NOT {_IS_PLACEHOLDERS} THEN '[ADDRESS]' ELSE x END), lambda x: NOT {_IS_PLACEHOLDERS}), chr(10)) AS redacted FROM {x}lines)"""


_NOT_ONE = "|".join(w for w in [*grounding.UNITS, *grounding.SCALES] if w != "one")
_DOCS = "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, text AS given FROM documents)"
_COUNTS = "(SELECT r, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in redact.KINDS) + " FROM kept GROUP BY r)"
_WHITE = r"\x{9}-\x{d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_PIECES = f"[0-9A-Za-z]+|[{_WHITE}-]+|[^0-9A-Za-z{_WHITE}-]"
_FLAT = f"lambda p: CASE WHEN regexp_matches(p, '^[{_WHITE}-]') THEN ' ' ELSE p END"
_LINES = " UNION ALL ".join(f"SELECT {i - len(VOCABULARY)}, '{x}'" for i, x in enumerate(VOCABULARY))
_HEADING = "regexp_replace(trim(line), ':$', '')"
_BLANK = r"[\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _decoded_sql(x: str) -> str:
    """One pass over numeric and six named entities."""
    shape = "(?i)&#([0-9]{1,7}|x[0-9a-f]{1,6});"
    code = "CASE WHEN lower(h[1]) = 'x' THEN CAST('0x' || h[2:] AS BIGINT) ELSE CAST(h AS BIGINT) END"
    letters = f"list_transform(regexp_extract_all({x}, '{shape}', 1), lambda h: CASE WHEN {code} BETWEEN 1 AND 1114111 THEN chr(({code})::INTEGER) ELSE '�' END)"
    out = f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{shape}'), {letters}), lambda z: z[1] || coalesce(z[2], '')), '')"
    for name, value in (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"regexp_replace({out}, '{name}', '{value}', 'gi')"
    return out


ORACLE = {
    "html_to_text": rf"""WITH one AS (SELECT page_id, {_decoded_sql('html')} AS t FROM pages), two AS (SELECT page_id, {_decoded_sql('t')} AS t FROM one),
        bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM two),
        done AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '(?s)</?[A-Za-z!][^>]*>', '', 'g'), '{_BLANK}', ' ', 'g'), ' ') AS t FROM bare)
        SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM done""",
    "pii_counts": f"""WITH RECURSIVE {_DOCS}, {_redacted_sql("docs", "")}
        SELECT {", ".join(f"coalesce(sum(c.{k}), 0)::BIGINT{' + sum(n_lines)::BIGINT' if k == 'address' else ''} AS n_{k}" for k in redact.KINDS)}, count(*) FILTER (redacted <> given) AS changed
        FROM docs JOIN done USING (r) LEFT JOIN {_COUNTS} c USING (r)""",
    "pii_values": rf"""WITH RECURSIVE {_DOCS}, persons AS (SELECT array_to_string(regexp_extract_all(text, '[0-9A-Za-z]+')[1:2], ' ') AS v FROM benchmark),
        named AS (SELECT DISTINCT lower(v) AS v FROM (SELECT v FROM persons UNION ALL SELECT unnest(list_filter(string_split(v, ' '), lambda x: length(x) >= 3)) FROM persons) WHERE v <> ''),
        pieces AS (SELECT r, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT r, regexp_extract_all(text, '[0-9A-Za-z_]+|\s+|[^0-9A-Za-z_\s]') AS ps FROM docs)),
        runs AS (SELECT r, lower(p) AS p1, CASE WHEN regexp_matches(lead(p, 1) OVER w, '^\s') THEN lower(p) || ' ' || lower(lead(p, 2) OVER w) END AS p2, sum(length(p)) OVER (w ROWS UNBOUNDED PRECEDING) - length(p) AS s,
            length(p) AS n1, length(p) + length(lead(p, 1) OVER w) + length(lead(p, 2) OVER w) AS n2 FROM pieces WINDOW w AS (PARTITION BY r ORDER BY i)),
        {_redacted_sql("docs", "", f"UNION ALL SELECT r, 'name', {redact.STORED_NAME}, s, s + n1 FROM runs JOIN named ON v = p1 UNION ALL SELECT r, 'name', {redact.STORED_NAME}, s, s + n2 FROM runs JOIN named ON v = p2")}
        SELECT doc_id, {", ".join(f"coalesce(c.{k}, 0)::INTEGER{' + n_lines::INTEGER' if k == 'address' else ''} AS n_{k}" for k in redact.KINDS)}, md5(redacted) AS redacted_md5
        FROM docs JOIN done USING (r) LEFT JOIN {_COUNTS} c USING (r)""",
    "pii_leaks_after_redaction": f"""WITH RECURSIVE {_DOCS}, {_redacted_sql("docs", "")}, again AS (SELECT r, redacted AS text FROM done), {_spans_sql("again", "a_")}
        SELECT kind, count(*) AS n FROM (SELECT DISTINCT r, kind FROM a_ok) GROUP BY kind""",
    "address_lines": f"""SELECT count(*) AS n, sum((t <> text)::BIGINT)::BIGINT AS changed FROM (SELECT text, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
          lambda x: CASE WHEN {_IS_ADDRESS} AND NOT {_IS_PLACEHOLDERS} THEN '[ADDRESS]' ELSE x END), lambda x: NOT {_IS_PLACEHOLDERS}), chr(10)) AS t FROM documents)""",
    "numbers_per_doc": rf"""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{X.NUMBER}'), lambda x: lower(regexp_replace(x, '\s', '', 'g'))) AS xs FROM documents),
        v AS (SELECT doc_id, list_transform(xs, lambda x: round(CAST(regexp_replace(x, '[km,]', '', 'g') AS DOUBLE) * CASE WHEN ends_with(x, 'k') THEN 1e3 WHEN ends_with(x, 'm') THEN 1e6 ELSE 1.0 END, 3)) AS vs FROM n)
        SELECT doc_id, len(vs)::INTEGER AS n, round(list_reduce(vs, lambda a, x: a + x, 0.0::DOUBLE), 3) AS total FROM v""",
    "vocabulary_terms": rf"""WITH RECURSIVE lines(ord, names) AS (
          SELECT item_id, [array_to_string(w[1:3], ' '), array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')] FROM (SELECT item_id, regexp_extract_all(text, '[0-9A-Za-z]+') AS w FROM benchmark)
          UNION ALL SELECT ord, string_split(line, '|') FROM ({_LINES}) t(ord, line) WHERE NOT starts_with(line, '#')),
        raws AS (SELECT ord, list_filter(list_transform(names, lambda x: trim(x)), lambda x: x <> '') AS names FROM lines),
        aliases AS (SELECT ord, pos, regexp_replace(names[1], '^=', '') AS canonical, regexp_replace(names[pos], '^=', '') AS alias, starts_with(names[pos], '=') OR length(regexp_replace(names[pos], '^=', '')) <= 2 AS exact
          FROM raws, unnest(range(1, len(names) + 1)) AS u(pos)),
        keyed AS (SELECT *, array_to_string(ps, '') AS own, lower(array_to_string(ps, '')) AS low, len(ps) AS n FROM (SELECT *, list_transform(regexp_extract_all(alias, '{_PIECES}'), {_FLAT}) AS ps FROM aliases)),
        texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_PIECES}') AS raw FROM documents),
        pieces AS (SELECT r, unnest(range(1, len(raw) + 1)) AS i, unnest(list_transform(raw, {_FLAT})) AS p, unnest(list_transform(raw, lambda p: length(p))) AS size FROM texts),
        runs AS (SELECT r, p AS p1, p || lead(p, 1) OVER w || lead(p, 2) OVER w AS p3, p || lead(p, 1) OVER w || lead(p, 2) OVER w || lead(p, 3) OVER w || lead(p, 4) OVER w AS p5,
            sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS s, size AS n1, size + lead(size, 1) OVER w + lead(size, 2) OVER w AS n3, size + lead(size, 1) OVER w + lead(size, 2) OVER w + lead(size, 3) OVER w + lead(size, 4) OVER w AS n5,
            lead(p, 1) OVER w AS f1, lead(p, 3) OVER w AS f3, lead(p, 5) OVER w AS f5 FROM pieces WINDOW w AS (PARTITION BY r ORDER BY i)),
        spots AS (SELECT r, s, 1 AS n, p1 AS p, n1 AS size, f1 AS f FROM runs UNION ALL SELECT r, s, 3, p3, n3, f3 FROM runs UNION ALL SELECT r, s, 5, p5, n5, f5 FROM runs),
        hits AS (SELECT x.r, x.s, x.s + x.size AS e, k.ord, k.pos, k.canonical FROM spots x JOIN keyed k ON lower(x.p) = k.low AND x.n = k.n
          WHERE (NOT k.exact OR x.p = k.own) AND NOT (regexp_matches(k.alias, '[0-9A-Za-z]$') AND coalesce(x.f IN ('+', '#'), false))),
        edges AS (SELECT *, s >= coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS apart FROM hits),
        grouped AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM edges),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r, g ORDER BY e - s DESC, ord, pos, s) AS k FROM grouped),
        taken AS (
          SELECT r, g, k, [{{'s': s::BIGINT, 'e': e::BIGINT, 'c': canonical}}] AS acc FROM ranked WHERE k = 1
          UNION ALL
          SELECT t.r, t.g, h.k, CASE WHEN len(list_filter(t.acc, lambda a: a.s < h.e AND h.s < a.e)) > 0 THEN t.acc ELSE list_append(t.acc, {{'s': h.s::BIGINT, 'e': h.e::BIGINT, 'c': h.canonical}}) END
          FROM taken t JOIN ranked h ON h.r = t.r AND h.g = t.g AND h.k = t.k + 1),
        done AS (SELECT r, g, max_by(acc, k) AS acc FROM taken GROUP BY r, g),
        named AS (SELECT r, c, min(s) AS s FROM (SELECT r, unnest(acc, recursive := true) FROM done) GROUP BY r, c)
        SELECT doc_id, coalesce(string_agg(n.c, ',' ORDER BY n.s), '') AS terms FROM texts LEFT JOIN named n USING (r) GROUP BY r, doc_id""",
    "secret_scrub": f"SELECT doc_id, md5({_SCRUBBED}) AS text_md5 FROM documents",
    "sections_of_doc": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        h AS (SELECT *, trim({_HEADING}) AS bare FROM l), k AS (SELECT *, CASE
          WHEN regexp_matches(bare, '(?i)^(professional\\s+summary|summary|profile|objective|about(\\s+me)?)$') THEN 'summary'
          WHEN regexp_matches(bare, '(?i)^(technical\\s+skills|core\\s+skills|skills|technologies|competencies)$') THEN 'skills'
          WHEN regexp_matches(bare, '(?i)^(professional\\s+experience|work\\s+experience|work\\s+history|experience|employment)$') THEN 'experience'
          WHEN regexp_matches(bare, '(?i)^(education|academic\\s+background|academics)$') THEN 'education'
          WHEN regexp_matches(bare, '(?i)^(personal\\s+projects|key\\s+projects|projects)$') THEN 'projects'
          WHEN regexp_matches(bare, '(?i)^(certifications|certificates|licenses|licences)$') THEN 'certifications'
          WHEN length(bare) <= 40 AND regexp_matches(bare, '[A-Z]') AND NOT regexp_matches(bare, '[.a-z]') THEN 'other' END AS h FROM h),
        m AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'other') AS section FROM k),
        j AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS t FROM m WHERE h IS NULL GROUP BY 1, 2)
        SELECT doc_id, section, md5(t) AS text_md5 FROM j WHERE t <> ''""",
    "url_check": r"""SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'invalid_url' WHEN page_id % 3 = 2 THEN 'host'
        WHEN page_id % 3 = 1 AND regexp_extract(url, '^https://([^/?#:]+)', 1) NOT IN ('thther.example.org', 'blog.tionsh.example.net') THEN 'host' END AS rejection FROM pages""",
    "email_counts": rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{redact.EMAIL}')) AS INTEGER) AS n_email FROM documents",
    "phrase_filter": f"SELECT doc_id, lang FROM documents WHERE regexp_matches({_NORM}, '(^|[^0-9A-Za-z])(license|the apache|copyright)([^0-9A-Za-z]|$)')",
    "normalised_words": rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words, md5({_NORM}) AS norm_md5 FROM documents",
    "excerpt_search": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents),
        i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS e FROM benchmark)
        SELECT doc_id, item_id FROM d JOIN i ON contains(t, e)""",
    "letter_rule_codes": rf"""WITH RECURSIVE t AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role = 'assistant'), l AS (SELECT * FROM t WHERE text <> ''),
        letters AS (SELECT row_number() OVER () AS r, text FROM l), {_spans_sql("letters", "")},
        b AS (SELECT text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(dear|hello|hi)\b[^\n]{{0,60}}$')
          AND NOT regexp_matches(p, '(?i)^(kind |best |warm )?(regards|sincerely|thanks)\b')) AS body FROM l), c AS (
        SELECT 'empty' AS code FROM t WHERE text = ''
        UNION ALL SELECT 'too_long' FROM l WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 200
        UNION ALL SELECT 'salutation' FROM l WHERE NOT starts_with(text, 'Dear Hiring Team,')
        UNION ALL SELECT 'name_placeholder_count' FROM l WHERE len(string_split(text, '{{{{NAME}}}}')) <> 2
        UNION ALL SELECT 'sign_off' FROM l WHERE NOT ends_with(text, '{{{{NAME}}}}')
        UNION ALL SELECT 'other_placeholder' FROM l WHERE regexp_matches(replace(text, '{{{{NAME}}}}', ''), '[{{}}]|\[[^\]]*\]')
        UNION ALL SELECT 'url' FROM l WHERE regexp_matches(text, '(?i)https?://|www\.|\b[a-z0-9-]+\.(com|org|io)\b')
        UNION ALL SELECT 'email' FROM l WHERE regexp_matches(text, '[^\s@]+@[^\s@]+\.[^\s@]+')
        UNION ALL SELECT 'phone' FROM l WHERE len(list_filter(regexp_extract_all(text, '\+?\d[\d\s().-]{{7,}}\d'), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 9)) > 0
        UNION ALL SELECT 'markdown' FROM l WHERE regexp_matches(text, '(?m)```|\*\*|__|^\s{{0,3}}#{{1,6}}\s|^\s*[-*•]\s')
        UNION ALL SELECT 'ungrounded_technology' FROM b WHERE len(list_filter(body[2:], lambda p: regexp_matches(p, '(^|[^0-9A-Za-z])la($|[^0-9A-Za-z+#])') OR regexp_matches(p, '(?i)(^|[^0-9A-Za-z])and($|[^0-9A-Za-z+#])'))) > 0
        UNION ALL SELECT 'pii' FROM (SELECT DISTINCT r FROM ok)
        UNION ALL SELECT 'ungrounded_number' FROM l WHERE regexp_matches(text, '{X.NUMBER}') OR regexp_matches(lower(text), '(^|[^a-z])({_NOT_ONE})([^a-z]|$)') OR regexp_matches(lower(text), '(^|[^a-z])one([^a-z]+({"|".join(grounding.COUNTED)})|[\s-]+one)([^a-z]|$)')
        UNION ALL SELECT 'ungrounded_domain' FROM l WHERE regexp_matches(text, '(?i)(^|[^0-9A-Za-z])(the|der)($|[^0-9A-Za-z])')
        UNION ALL SELECT 'internal_label' FROM l WHERE regexp_matches(text, '(?i)\b(must-have|nice-to-have|skills\s+matrix|basedOn|prompt|the\s+profile|candidate\s+profile)\b'))
        SELECT code, count(*) AS n FROM c GROUP BY 1""",
}
