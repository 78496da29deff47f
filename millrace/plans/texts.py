"""Replies checked by schema, and pieces of texts from SQL.

The reply texts are made of order rows by one SELECT that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import table
from millrace.functions.text import NUMBER
from millrace.operators import grounding, redact, replies, schemas
from millrace.plans.corpus import _redacted_sql
from millrace.runtime import read, spread

# Keys and replies; in some replies a field is wrong.
REPLIES_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 23 WHEN 0 THEN 'no' WHEN 1 THEN '[1]' ELSE
  '{{"skillsFit":' || CASE o_orderkey % 7 WHEN 0 THEN '"high"' WHEN 1 THEN '120' WHEN 2 THEN '55.5' ELSE '' || (o_orderkey % 101) END
  || ',"seniorityFit":' || CASE o_orderkey % 11 WHEN 0 THEN '-1' WHEN 1 THEN 'null' ELSE '' || (o_orderkey % 100) END
  || ',"matchedSkills":' || CASE o_orderkey % 13 WHEN 0 THEN '"java"' WHEN 1 THEN '["a",5]' ELSE '["  ' || o_orderpriority || ' ","","' || o_clerk_text || '","c","d","e","f","g","h","i"]' END
  || ',"missingSkills":[]' || CASE o_orderkey % 5 WHEN 0 THEN '' ELSE ',"redFlags":[" x ","' || o_clerk_text || '","y","z"]' END
  || ',"reason":"' || CASE o_orderkey % 17 WHEN 0 THEN '   ' ELSE o_clerk_text || ' ' || o_clerk_text END
  || '","roleType":"' || CASE o_orderkey % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'lead' ELSE CASE o_orderkey % 19 WHEN 0 THEN 'boss' ELSE 'other' END END || '","score":99}}' END AS json
FROM (SELECT o_orderkey, o_orderpriority, 'about ' || o_orderpriority || ' in ' || p_name || ' and ' || p_type || ' of ' || p_name || ' by ' || o_orderstatus || p_type AS o_clerk_text
  FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})) x
"""
MATRIX_SQL = """
SELECT o_orderkey AS id, '{{"yearsExperience":' || CASE o_orderkey % 7 WHEN 0 THEN '-2' WHEN 1 THEN '2.5' WHEN 2 THEN '"3"' ELSE '' || (o_orderkey % 30) END
  || ',"currentLevel":"' || CASE o_orderkey % 11 WHEN 0 THEN ' ' ELSE ' ' || o_orderstatus || ' level ' END || '","targetRoles":["' || o_orderpriority || '"],"mustHave":'
  || CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[" a ","b"]' ELSE '["' || o_orderpriority || '","x"]' END || ',"niceToHave":' || CASE o_orderkey % 13 WHEN 0 THEN '["a",""]' ELSE '["n"]' END
  || ',"avoid":' || CASE o_orderkey % 17 WHEN 0 THEN '{{}}' ELSE '[]' END || CASE o_orderkey % 19 WHEN 0 THEN '' ELSE ',"strengths":["s"]' END || '}}' AS json
FROM {orders} o
"""
# Postings whose texts hold personal data, white space, markup signs and instructions for some keys.
POSTINGS_SQL = """
SELECT o_orderkey AS id, p_name || CASE o_orderkey % 6 WHEN 0 THEN ' {{{{x}}}}' WHEN 1 THEN ' [' || o_orderpriority || ']' ELSE '' END AS title, c_name AS company, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE n_name END AS location,
  'About  ' || p_type || '\n\n' || CASE o_orderkey % 5 WHEN 0 THEN 'mail hr' || o_orderkey || '@jobs.example, now' WHEN 1 THEN 'call +1 415 555 ' || (1000 + o_orderkey % 9000) || ' or www.x.example/' || o_orderkey || '.' WHEN 2 THEN '9 Main Street' ELSE 'nothing' END
  || '\nYou ARE  now ' || CASE o_orderkey % 4 WHEN 0 THEN 'reading' ELSE 'not reading the system PROMPT' END || repeat(' ' || p_brand, CAST(o_orderkey % 9 AS INT)) AS description,
  o_orderkey % 3 <> 0 AS salary_known, o_orderkey % 13 = 0 AS salary_is_estimated, CASE o_orderkey % 8 WHEN 0 THEN NULL ELSE 'EUR' END AS currency, o_totalprice AS salary_min, CASE o_orderkey % 11 WHEN 0 THEN NULL ELSE o_totalprice * 2 END AS salary_max,
  o_orderkey % 10 = 0 AS description_is_snippet
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part}) JOIN {customer} c ON c_custkey = o_custkey JOIN {nation} n ON n_nationkey = c_nationkey
"""
# Lists of suggestions; some are too long, too many, no plain text or without a basis.
SUGGESTIONS_SQL = """
SELECT o_orderkey AS id, 3 + o_orderkey % 4 - CASE o_orderkey % 9 WHEN 0 THEN 1 ELSE 0 END AS n, p_name AS basis, 'We sell ' || p_name || ' of ' || p_type || ' here' AS source,
  CASE o_orderkey % 5 WHEN 0 THEN 'see www.a.example' WHEN 1 THEN 'Use the prompt' WHEN 2 THEN repeat('word ', CAST(20 + o_orderkey % 12 AS INT)) ELSE 'Name ' || p_type END AS odd
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})
"""
TABLES = ("orders", "part", "customer", "nation")
LIMIT = 90


def _replies(spark, sf_dir, sql):
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in TABLES})


def judgement_replies(spark, sf_dir):
    """Judgements: what is wrong with them, and what is taken from the right ones."""
    got = schemas.validate(_replies(spark, sf_dir, REPLIES_SQL), schemas.JUDGEMENT)
    v = F.col("value")
    return got.select("id", F.array_join("errors", "; ").alias("errors"), v["skillsFit"].alias("skills_fit"), F.array_join(v["matchedSkills"], "|").alias("matched"), F.array_join(v["redFlags"], "|").alias("flags"), v["reason"].alias("reason"), v["roleType"].alias("role_type"))


def matrix_replies(spark, sf_dir):
    """Skills matrices, checked and as text."""
    got = schemas.validate(_replies(spark, sf_dir, MATRIX_SQL), schemas.MATRIX)
    return got.select("id", F.array_join("errors", "; ").alias("errors"), schemas.format_matrix(F.col("value")).alias("text"))


def text_pieces(spark, sf_dir):
    """Emails, URLs and numbers of documents, by a table function called from SQL."""
    table.register(spark)
    return spark.sql(
        "SELECT doc_id, kind, count(*) AS n, sum(start) AS starts, sum(end) AS ends, md5(array_join(array_sort(collect_list(piece)), '|')) AS pieces_md5 FROM {documents} d, LATERAL text_pieces(d.text) p GROUP BY doc_id, kind",
        documents=spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def extracted_objects(spark, sf_dir):
    """The first JSON object of replies that also hold reasoning, fences and prose."""
    text = F.concat(F.when(F.col("id") % 3 == 0, "<think>{no}</think> ").otherwise("Sure: "), F.lit("```json\n"), F.when(F.col("id") % 5 == 0, F.expr("substr(json, 1, length(json) - 1)")).otherwise(F.col("json")), F.lit("\n``` {done}"))
    rows = spread(_replies(spark, sf_dir, MATRIX_SQL)).select("id", text.alias("text"))
    return replies.extract_json(rows).select("id", "json", "failure")


def sanitised_texts(spark, sf_dir):
    """Descriptions as requests show them, and whether they try to give instructions."""
    return redact.sanitise(_replies(spark, sf_dir, POSTINGS_SQL), "description", LIMIT).select("id", "sanitised", "injection_suspected")


TEMPLATE = "{{snippetRule}}\nTitle: {{title}}\nCompany: {{company}}\nLocation: {{location}}\nSalary: {{salary}}\nDescription: {{description}}"


def request_texts(spark, sf_dir):
    """Requests of postings, filled into a template."""
    rows = replies.posting_fields(_replies(spark, sf_dir, POSTINGS_SQL), LIMIT)
    text, problems = replies.render(TEMPLATE, {name: F.col(name) for name in ("snippetRule", "title", "company", "location", "salary", "description")})
    if problems:
        raise ValueError("; ".join(problems))
    return rows.select("id", text.alias("request"), "injection_suspected")


def suggestion_lists(spark, sf_dir):
    """Lists of suggestions: refused ones with their errors, and how many items of the others stay."""
    item = lambda i: F.struct(
        F.lit("Skills").alias("section"), F.when(i == 1, F.col("odd")).otherwise(F.concat(F.lit("Show "), "basis")).alias("suggestion"), F.lit("It is asked for").alias("reason"),
        F.when(i == 2, F.when(F.col("id") % 7 == 0, "not there").otherwise(F.upper("basis"))).otherwise(F.concat(F.col("basis"), F.lit(" of"))).alias("basedOn"))
    rows = _replies(spark, sf_dir, SUGGESTIONS_SQL).withColumn("items", F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), item))
    out = grounding.kept_suggestions(rows, "items", "source", ["banking"])
    return out.select("id", F.array_join("errors", "; ").alias("errors"), F.size("kept").alias("kept"), "valid")


QUERIES = {f.__name__: f for f in (judgement_replies, matrix_replies, text_pieces, extracted_objects, sanitised_texts, request_texts, suggestion_lists)}


def _sql_of(made: str) -> str:
    return made.format(**{t: t for t in TABLES})


def _trimmed(x: str, limit: int) -> str:
    """A text cut at a word boundary so that it fits with an ellipsis."""
    t = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return rf"CASE WHEN length({t}) <= {limit} THEN {t} ELSE coalesce(nullif(regexp_replace(substr({t}, 1, {limit - 1}), '\s+\S*$', ''), ''), substr({t}, 1, {limit - 1})) || '…' END"


def _list_sql(key: str, filled: bool) -> str:
    """Errors of a list of texts."""
    k, x = f"json -> '$.{key}'", f"json_extract(json, '$.{key}[' || i || ']')"
    empty = f" WHEN trim({x} ->> '$') = '' THEN 'empty'" if filled else ""
    bad = f"CASE WHEN json_type({x}) IS DISTINCT FROM 'VARCHAR' THEN 'not a text'{empty} END"
    return f"CASE WHEN json_type({k}) IS DISTINCT FROM 'ARRAY' THEN ['{key}: not a list'] ELSE list_filter(list_transform(range(0, json_array_length({k})::BIGINT), lambda i: '{key}[' || i || ']: ' || {bad}), lambda e: e IS NOT NULL) END"


def _number_sql(key: str, wrong: str) -> str:
    x = f"(json ->> '$.{key}')"
    number = f"json_type(json -> '$.{key}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    return f"CASE WHEN {number} IS NOT TRUE THEN ['{key}: not a number'] WHEN {wrong.format(x=f'CAST({x} AS DOUBLE)')} THEN ['{key}: out of range'] ELSE [] END"


def _texts(key: str, items: int, length: int) -> str:
    return f"array_to_string(list_transform(list_filter(list_transform(CAST(json -> '$.{key}' AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')[1:{items}], lambda x: {_trimmed('x', length)}), '|')"


_READ = "SELECT id, CASE WHEN json_valid(json) AND json_type(json) = 'OBJECT' THEN CAST(json AS JSON) END AS json FROM made"
_SHAPES = [("email", redact.EMAIL)] + [("url", "(?i)" + p) for p in redact.URL_SHAPES] + [("number", NUMBER)]


def _pieces_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    one = lambda i, kind, p: f"""SELECT doc_id, '{kind}' AS kind, {i} AS shape, unnest(range(1, len(regexp_extract_all(text, {q(p)})) + 1)) AS i, unnest(string_split_regex(text, {q(p)})[:len(regexp_extract_all(text, {q(p)}))]) AS b,
          unnest(regexp_extract_all(text, {q(p)})) AS m FROM documents WHERE regexp_matches(text, {q(p)})"""  # noqa: E731
    return f"""WITH found AS ({" UNION ALL ".join(one(i, k, p) for i, (k, p) in enumerate(_SHAPES))}),
        placed AS (SELECT doc_id, kind, CASE WHEN kind = 'url' THEN regexp_replace(m, {q(redact.URL_END)}, '') ELSE m END AS piece, sum(length(b)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM found WINDOW w AS (PARTITION BY doc_id, shape ORDER BY i ROWS UNBOUNDED PRECEDING)),
        once AS (SELECT DISTINCT doc_id, kind, piece, s FROM placed WHERE piece <> '')
        SELECT doc_id, kind, count(*) AS n, sum(s)::BIGINT AS starts, sum(s + length(piece))::BIGINT AS ends, md5(string_agg(piece, '|' ORDER BY piece)) AS pieces_md5 FROM once GROUP BY doc_id, kind"""


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_SANITISED = f"""made AS ({_sql_of(POSTINGS_SQL)}), docs AS (SELECT id AS r, {_clean('description')} AS text FROM made), {_redacted_sql("docs", "")},
  safe AS (SELECT r AS id, substr({_clean('redacted')}, 1, {LIMIT}) AS sanitised FROM done)"""
_SUSPECTED = " OR ".join(f"contains(lower(sanitised), '{p}')" for p in redact.INJECTION)
_PLAIN = lambda x: _clean(f"regexp_replace(coalesce({x}, ''), '[<>{{}}]', ' ', 'g')")
ORACLE = {
    "sanitised_texts": f"WITH RECURSIVE {_SANITISED} SELECT id, sanitised, {_SUSPECTED} AS injection_suspected FROM safe",
    "request_texts": f"""WITH RECURSIVE {_SANITISED}, told AS (SELECT m.*, s.sanitised, CASE WHEN salary_known AND NOT salary_is_estimated THEN trim(coalesce(currency, '') || ' ' || coalesce(CAST(CAST(floor(salary_min + 0.5) AS BIGINT) AS VARCHAR), '?') || ' to '
          || coalesce(CAST(CAST(floor(salary_max + 0.5) AS BIGINT) AS VARCHAR), '?')) ELSE '{replies.NOT_STATED}' END AS pay FROM made m JOIN safe s USING (id))
        SELECT id, CASE WHEN description_is_snippet THEN {_clean("'" + replies.SNIPPET_RULE + "'")} ELSE '' END || chr(10) || 'Title: ' || {_PLAIN('title')} || chr(10) || 'Company: ' || {_PLAIN('company')} || chr(10) || 'Location: ' || {_PLAIN('location')}
          || chr(10) || 'Salary: ' || pay || chr(10) || 'Description: ' || {_PLAIN('sanitised')} AS request, {_SUSPECTED} AS injection_suspected FROM told""",
    "suggestion_lists": rf"""WITH made AS ({_sql_of(SUGGESTIONS_SQL)}), told AS (SELECT *, list_concat(CASE WHEN n BETWEEN 3 AND 5 THEN [] ELSE ['wrong number of items'] END, list_concat(
          CASE WHEN len(string_split_regex(trim(odd), '\s+')) > 25 THEN ['[0] suggestion is too long'] ELSE [] END, CASE WHEN regexp_matches(odd, '{grounding.NOT_PLAIN}') THEN ['[0] suggestion is no plain text'] ELSE [] END)) AS errors FROM made)
        SELECT id, array_to_string(errors, '; ') AS errors, CASE WHEN len(errors) > 0 THEN 0 ELSE n - (CASE WHEN regexp_matches(odd, '{grounding.LABELS}') THEN 1 ELSE 0 END) - (CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) END::INTEGER AS kept,
          len(errors) = 0 AND n - (CASE WHEN regexp_matches(odd, '{grounding.LABELS}') THEN 1 ELSE 0 END) - (CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) >= 3 AS valid FROM told""",
    "text_pieces": _pieces_sql(),
    "judgement_replies": f"""WITH made AS ({_sql_of(REPLIES_SQL)}), parsed AS ({_READ}), told AS (SELECT id, json, CASE WHEN json IS NULL THEN ['$: not an object'] ELSE list_concat(list_concat(list_concat(
          {_number_sql('skillsFit', '{x} < 0 OR {x} > 100')}, {_number_sql('seniorityFit', '{x} < 0 OR {x} > 100')}), list_concat({_list_sql('matchedSkills', False)}, list_concat({_list_sql('missingSkills', False)}, {_list_sql('redFlags', False)}))),
          list_concat(CASE WHEN trim(json ->> '$.reason') = '' THEN ['reason: empty'] ELSE [] END, CASE WHEN (json ->> '$.roleType') NOT IN ('backend', 'lead', 'architect', 'other') THEN ['roleType: not allowed'] ELSE [] END)) END AS errors FROM parsed),
        good AS (SELECT *, len(errors) = 0 AS ok FROM told)
        SELECT id, array_to_string(errors, '; ') AS errors, CASE WHEN ok THEN CAST(json ->> '$.skillsFit' AS DOUBLE) END AS skills_fit, CASE WHEN ok THEN {_texts('matchedSkills', 8, 80)} END AS matched, CASE WHEN ok THEN {_texts('redFlags', 3, 120)} END AS flags,
          CASE WHEN ok THEN {_trimmed("json ->> '$.reason'", 200)} END AS reason, CASE WHEN ok THEN json ->> '$.roleType' END AS role_type FROM good""",
    "matrix_replies": f"""WITH made AS ({_sql_of(MATRIX_SQL)}), parsed AS ({_READ}), told AS (SELECT id, json, list_concat(list_concat({_number_sql('yearsExperience', '{x} < 0')}, CASE WHEN trim(json ->> '$.currentLevel') = '' THEN ['currentLevel: empty'] ELSE [] END),
          list_concat(list_concat({_list_sql('targetRoles', True)}, {_list_sql('mustHave', True)}), list_concat({_list_sql('niceToHave', True)}, list_concat({_list_sql('avoid', True)}, {_list_sql('strengths', True)})))) AS errors FROM parsed)
        SELECT id, array_to_string(errors, '; ') AS errors, CASE WHEN len(errors) = 0 THEN 'Years of experience: ' || (json ->> '$.yearsExperience') || chr(10) || 'Level: ' || trim(json ->> '$.currentLevel') || chr(10) ||
          {" || chr(10) || ".join(f"'{name}: ' || coalesce(nullif(array_to_string(list_transform(CAST(json -> '$.{key}' AS VARCHAR[]), lambda x: trim(x)), ', '), ''), '(none)')" for name, key in (("Target roles", "targetRoles"), ("Must have", "mustHave"), ("Nice to have", "niceToHave"), ("Avoid", "avoid"), ("Strengths", "strengths")))} END AS text FROM told""",
    "extracted_objects": f"""WITH made AS ({_sql_of(MATRIX_SQL)}) SELECT id, CASE WHEN id % 5 <> 0 THEN json END AS json, CASE WHEN id % 5 = 0 THEN 'unbalanced' END AS failure FROM made""",
}
