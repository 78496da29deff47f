"""Chat formatting with tool-call linking (operator 10).

Calls and results meet in a hash join on (conversation, call id).  A call may
name the call it waits for; its depth in that order comes from pointer doubling
(each round joins the table of ancestors with itself, so a chain of d calls
takes log2(d) rounds), which needs no group of a whole conversation in one
task.  Arguments are parsed as variants, checked against the tool's schema and
written back as canonical JSON: sorted keys, no white space.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut

# A schema: tool -> argument -> (type, required); types: string, integer, number, boolean, array, object.
Schema = dict[str, dict[str, tuple[str, bool]]]
KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",),
    "array": ("ARRAY",), "object": ("OBJECT",),
}


def argument_errors(tool: Column, arguments: Column, parsed: Column, schemas: Schema) -> Column:
    """array<string> of violations, empty if the arguments fit the schema."""
    out: list[Column] = [
        F.when(tool.isNull() | ~tool.isin(*schemas), F.lit("unknown tool")),
        F.when(parsed.isNull(), F.lit("arguments are not JSON")),
    ]
    for name, args in schemas.items():
        mine = (tool == name) & parsed.isNotNull()
        is_object = F.schema_of_variant(parsed).startswith("OBJECT")
        out.append(F.when(mine & ~is_object, F.lit("arguments are not an object")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in args]))
        out.append(F.when(mine & is_object & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        for arg, (kind, required) in args.items():
            value = F.try_variant_get(parsed, f"$.{arg}", "variant")
            there = value.isNotNull() & ~F.is_variant_null(value)
            fits = F.schema_of_variant(value).rlike("^(" + "|".join(KINDS[kind]) + ")")
            out.append(F.when(mine & is_object & there & ~fits, F.lit(f"{arg} is not {kind}")))
            if required:
                out.append(F.when(mine & is_object & ~F.coalesce(there, F.lit(False)), F.lit(f"{arg} is missing")))
    return F.array_compact(F.array(*out))


def depths(calls: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, call_id, depth): how many calls must come before a call.

    A parent that does not exist counts as none; calls in or behind a cycle get
    a null depth."""
    ids = calls.select("conv_id", "call_id")
    known = ids.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    up = calls.select("conv_id", "call_id", "parent_id").join(known, ["conv_id", "parent_id"], "left")
    live = cut(up.select("conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up")).withColumn("d", F.when(F.col("up").isNotNull(), 1).otherwise(0)))
    done = live.where("up is null").select("conv_id", "call_id", "d")
    live = live.where("up is not null")
    before = -1
    for _ in range(max_rounds):
        left = live.count()
        if left in (0, before):  # finished, or only cycles remain
            break
        before = left
        hop = done.select("conv_id", F.col("call_id").alias("up"), F.col("d").alias("more"), F.lit(None).cast("string").alias("next")).unionByName(
            live.select("conv_id", F.col("call_id").alias("up"), F.col("d").alias("more"), F.col("up").alias("next")))
        step = cut(live.join(hop, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("d") + F.col("more")).alias("d")))
        done = cut(done.unionByName(step.where("up is null").select("conv_id", "call_id", "d")))
        live = step.where("up is not null")
    return done.unionByName(live.select("conv_id", "call_id", F.lit(None).cast("int").alias("d"))).withColumnRenamed("d", "depth")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """One row per call and one per result without a call.

    calls: conv_id, turn, call_id, tool, arguments (JSON text), parent_id;
    results: conv_id, turn, call_id, content.  Output: conv_id, call_id, turn,
    result_turn, n_results, depth, position, status, errors, json.

    A call id that repeats in its conversation keeps its first call (by turn,
    tool, arguments); of several results the first by turn is linked and all are
    counted.  Rows without conv_id or call_id cannot be linked: such results
    count as orphans, such calls as calls without result, one row each.
    status: ok, invalid (errors is not empty), no_result, orphan_result, cycle;
    the first that applies of cycle, invalid, no_result.  position orders calls
    and results topologically: 2 * depth, the result right after its call.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    columns = ["conv_id", "call_id", "turn", "tool", "arguments", "parent_id"]
    once = calls.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "tool", "arguments", "parent_id")).alias("x"))
    once = cut(once.select("conv_id", "call_id", "x.turn", "x.tool", "x.arguments", "x.parent_id"))
    order = cut(depths(once))
    keyed = once.join(order, ["conv_id", "call_id"]).unionByName(calls.where(~named).select(*columns, F.lit(0).alias("depth")))
    answered = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answered = answered.withColumn("answered", F.lit(True))
    linked = keyed.join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    parsed = F.try_parse_json("arguments")
    linked = linked.withColumn("parsed", parsed).withColumn("errors", argument_errors(F.col("tool"), F.col("arguments"), F.col("parsed"), schemas))
    status = (
        F.when(F.col("depth").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "no_result").otherwise("ok"))
    done = linked.select(
        "conv_id", "call_id", "turn", F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        "depth", (F.col("depth") * 2).alias("position"), status.alias("status"), "errors",
        canonical(F.col("parsed"), F.col("call_id"), F.col("r.content"), F.col("tool")).alias("json"))
    lost = results.where(named).join(once.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").unionByName(results.where(~named))
    none = F.lit(None)
    orphans = lost.select(
        "conv_id", "call_id", none.cast(calls.schema["turn"].dataType).alias("turn"), F.col("turn").alias("result_turn"), F.lit(1).cast("long").alias("n_results"),
        none.cast("int").alias("depth"), none.cast("int").alias("position"), F.lit("orphan_result").alias("status"),
        F.expr("cast(array() as array<string>)").alias("errors"), canonical(none.cast("variant"), F.col("call_id"), F.col("content"), none.cast("string")).alias("json"))
    return done.unionByName(orphans)


def canonical(arguments: Column, call_id: Column, content: Column, tool: Column) -> Column:
    """{"arguments":..,"call_id":..,"content":..,"tool":..}: keys in order,
    absent values left out; null arguments (not JSON) are left out too."""
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    quoted = lambda c: F.when(c.isNotNull(), _inner(F.to_json(F.array(c))))
    parts = F.array_compact(F.array(
        field("arguments", F.to_json(arguments)), field("call_id", quoted(call_id)), field("content", quoted(content)), field("tool", quoted(tool))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _inner(array_json: Column) -> Column:
    """The single element of a JSON array text."""
    return F.substring(array_json, F.lit(2), F.length(array_json) - 2)


# ------------------------------------------------------- calls of plain chats

# The tools that plain conversations are read as calls of.
CHAT_SCHEMAS: Schema = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"key": ("string", True), "strict": ("boolean", False)},
    "rewrite": {"text": ("string", True), "max_words": ("integer", True), "style": ("string", False)},
}


def calls_of_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read plain conversations as tool use: every user turn is a call that
    waits for the user turn two before it, every assistant turn the result of
    the turn before it.  The tool follows from the text's length, the
    arguments are built from the text in no particular key order.  A call to
    ``rewrite`` of a text of one line lacks ``max_words``.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    name = lambda t: F.when(conv.isNotNull() & t.isNotNull(), F.concat(conv.cast("string"), F.lit(":"), t.cast("string")))
    quoted = _inner(F.to_json(F.array(text)))
    n_words = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    pick = F.length(text) % 3
    lines = F.size(F.split(text, "\n"))
    arguments = (
        F.when(pick == 0, F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), n_words.cast("string"), F.lit("}")))
        .when(pick == 1, F.concat(F.lit('{"strict": '), F.when(n_words % 2 == 0, "true").otherwise("false"), F.lit(', "key": '), quoted, F.lit("}")))
        .when(lines > 1, F.concat(F.lit('{"text": '), quoted, F.lit(', "style": "plain", "max_words": '), n_words.cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"text": '), quoted, F.lit(', "style": "plain"}'))))
    tool = F.when(pick == 0, "search").when(pick == 1, "lookup").otherwise("rewrite")
    calls = messages.where(F.col("role") == "user").select(
        "conv_id", "turn", name(turn).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), name(turn - 2).alias("parent_id"))
    results = messages.where(F.col("role") == "assistant").select("conv_id", "turn", name(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results


def op10_tool_calls(conversations: DataFrame) -> DataFrame:
    """Linked calls of all conversations; errors joined by "; "."""
    calls, results = calls_of_chat(conversations)
    linked = link_calls(calls, results, CHAT_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


ORACLE_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (
  SELECT *, len(string_split_regex(text, '[\x20\x09-\x0D]+')) AS n, len(string_split(text, chr(10))) AS lines, length(text) % 3 AS pick,
         CAST(to_json(text) AS VARCHAR) AS q, conv_id || ':' || turn AS call_id,
         turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM m WHERE role = 'user'
), c AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS depth FROM u
), k AS (
  SELECT c.*, a.turn AS result_turn, a.text AS answer, pick = 2 AND lines = 1 AS bad
  FROM c LEFT JOIN m a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1
), o AS (
  SELECT a.* FROM m a LEFT JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE a.role = 'assistant' AND c.conv_id IS NULL
)
SELECT conv_id, call_id, turn, result_turn, CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, depth, depth * 2 AS position,
       CASE WHEN bad THEN 'invalid' WHEN result_turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       CASE WHEN bad THEN 'max_words is missing' ELSE '' END AS errors,
       '{"arguments":' || CASE
           WHEN pick = 0 THEN '{"limit":' || n || ',"query":' || q || '}'
           WHEN pick = 1 THEN '{"key":' || q || ',"strict":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}'
           WHEN lines > 1 THEN '{"max_words":' || n || ',"style":"plain","text":' || q || '}'
           ELSE '{"style":"plain","text":' || q || '}' END
         || ',"call_id":"' || call_id || '"' || CASE WHEN answer IS NULL THEN '' ELSE ',"content":' || CAST(to_json(answer) AS VARCHAR) END
         || ',"tool":"' || CASE pick WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'rewrite' END || '"}' AS json
FROM k
UNION ALL
SELECT conv_id, conv_id || ':' || (turn - 1), NULL, turn, 1, NULL, NULL, 'orphan_result', '',
       '{"call_id":"' || conv_id || ':' || (turn - 1) || '","content":' || CAST(to_json(text) AS VARCHAR) || '}'
FROM o
"""
