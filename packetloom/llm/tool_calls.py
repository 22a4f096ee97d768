"""Chat formatting: tool calls are linked with their results.

A message is (conv_id, turn, role, text). Calls come from JSON in the text of an assistant
({"tool_calls": [{"id", "name", "arguments", "after"}]}, `after` being the id, or a list of ids, of calls whose results this
one needs) and results from messages of role tool ({"tool_call_id", "content"}). Plain chats have their calls too: a
user turn calls the tool `reply` with arguments {"prompt"}, needing the previous user turn's result; the next message that is
no tool call or tool result, if an assistant's, is its result. Turns are neighbours by order, whatever their numbers. Calls and
results meet in an equi-join on (conv_id, id). A call's level, its place in topological order, is the longest way from a call
that needs nothing: chains of single needs by pointer doubling in log2(length) joins, calls of several needs once all of these
have levels. Arguments keep their JSON types; they are checked against the tool's schema, and every
linked call is serialised as canonical JSON (keys sorted at every depth, no spaces).

Messages with a null conv_id or turn are no calls. A null text is an empty one. Of rows with equal conv_id, turn and role the
least text counts. Repeated ids in a conversation: the first by turn counts, for calls and for results. A need that names no
call is left out of the level and makes the call invalid; calls on a cycle, and those that need them, have a null level and are not
valid. Broken JSON is no call; arguments that are no object are invalid. No messages give no rows. Columns besides these four
are ignored. No step gathers a conversation: keys are (conv_id, id), and order comes from a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import ranked, stash, table

#: Tool: argument name to (JSON type, required).
SCHEMAS = {"reply": {"prompt": ("string", True)}, "search": {"query": ("string", True), "limit": ("integer", True), "filters": ("object", False)}}
CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,after:variant>>>"
RESULT = "struct<tool_call_id:string,content:string>"
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def fits(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the arguments (a variant) are an object with what the tool's schema needs, of the right types, and nothing else."""
    held = F.try_variant_get(arguments, "$", "map<string,variant>")
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        ok = F.size(F.array_except(F.map_keys(held), F.array(*map(F.lit, schema)).cast("array<string>"))) == 0
        for key, (kind, required) in schema.items():
            value = F.try_element_at(held, F.lit(key))
            ok = ok & F.coalesce(F.schema_of_variant(value).rlike(f"(?s)^(?:{KINDS[kind]})$"), F.lit(not required))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def calls_of(messages: DataFrame, schemas: dict) -> tuple[DataFrame, DataFrame]:
    """conv_id, id, turn, name, arguments (canonical JSON), fit, after (ids); and the results of plain turns: conv_id, id, turn, content."""
    read = F.when((F.col("role") == "assistant") & F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", CALLS))
    told = messages.withColumn("c", read["tool_calls"])
    own = told.where("c IS NOT NULL").select("conv_id", "turn", F.posexplode("c").alias("i", "c")).where("c.id IS NOT NULL")
    needs = F.when(F.schema_of_variant("c.after").startswith("ARRAY"), F.try_variant_get("c.after", "$", "array<string>")).otherwise(F.array(F.try_variant_get("c.after", "$", "string")))
    needs = F.coalesce(F.filter(F.array_distinct(needs), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    own = own.select("conv_id", "c.id", "turn", "i", "c.name", F.coalesce(F.to_json("c.arguments"), F.lit("null")).alias("arguments"), fits(F.col("c.name"), F.col("c.arguments"), schemas).alias("fit"), needs.alias("after"))
    plain = told.where("c IS NULL AND role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text", (F.col("role") == "user").cast("int").alias("asks"))
    plain = ranked(plain, ["conv_id", "turn", "role"], "call-order", "asks").select("conv_id", "turn", "role", "text", "rank", F.col("start").alias("asked"))
    said, name = plain.where("role = 'user'"), F.concat(F.lit("turn-"), F.col("turn"))
    before = said.select("conv_id", (F.col("asked") + 1).alias("asked"), F.concat(F.lit("turn-"), F.col("turn")).alias("after"))
    asked = said.join(before, ["conv_id", "asked"], "left")
    canonical = F.to_json(F.struct(F.col("text").alias("prompt")))
    known = "reply" in schemas and schemas["reply"] == SCHEMAS["reply"]
    fit = F.lit(True) if known else fits(F.lit("reply"), F.parse_json(canonical), schemas)
    asked = asked.select("conv_id", name.alias("id"), "turn", F.lit(-1).alias("i"), F.lit("reply").alias("name"), canonical.alias("arguments"), fit.alias("fit"), F.array_compact(F.array("after")).alias("after"))
    told_next = plain.where("role = 'assistant'").select("conv_id", (F.col("rank") - 1).alias("rank"), F.col("turn").alias("at"), F.col("text").alias("content"))
    answers = said.select("conv_id", "rank", name.alias("id")).join(told_next, ["conv_id", "rank"]).select("conv_id", "id", F.col("at").alias("turn"), "content")
    every = own.unionByName(asked)
    first = F.min(F.struct("turn", "i", "name", "arguments", "fit", "after")).alias("c")
    return stash(every.groupBy("conv_id", "id").agg(first).select("conv_id", "id", "c.turn", "c.name", "c.arguments", "c.fit", "c.after"), "calls"), answers


def results_of(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """conv_id, id, result_turn, content."""
    own = messages.where("role = 'tool'").withColumn("r", F.from_json("text", RESULT)).select("conv_id", F.col("r.tool_call_id").alias("id"), "turn", F.col("r.content").alias("content"))
    return own.unionByName(answers).where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv_id", "id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level, known (whether every need names a call)."""
    needs = calls.select("conv_id", "id", F.explode("after").alias("need"))
    there = needs.join(calls.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"])
    needs = stash(there, "call-needs")
    some = needs.groupBy("conv_id", "id").agg(F.count("*").alias("k"), F.min("need").alias("up"))
    at = calls.join(some, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("k", F.lit(0)).alias("k"), "up", (F.size("after") == F.coalesce("k", F.lit(0))).alias("known"))
    # a call of one need points at it; others end a chain
    single = F.col("k") == 1
    at = stash(at.select("conv_id", "id", "k", "known", F.when(single, F.col("up")).otherwise(F.col("id")).alias("anchor"), single.cast("int").alias("steps"), (~single).alias("done")), "call-levels")
    left, rounds = at.where("NOT done").count(), 0
    longest = left.bit_length() + 1
    while left and rounds <= longest:
        over = at.select("conv_id", F.col("id").alias("anchor"), F.col("anchor").alias("further"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        at = stash(at.join(over, ["conv_id", "anchor"]).select("conv_id", "id", "k", "known", F.col("further").alias("anchor"), (F.col("steps") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("steps"), "ends").withColumnRenamed("ends", "done"), "call-levels")
        left, rounds = at.where("NOT done").count(), rounds + 1
    open_ = stash(needs.join(at.where("k > 1").select("conv_id", "id"), ["conv_id", "id"], "left_semi").join(at.select("conv_id", F.col("id").alias("need"), "anchor", "steps", "done"), ["conv_id", "need"]), "call-joins")
    if not open_.take(1):
        return at.select("conv_id", "id", F.when(F.col("done"), F.col("steps")).alias("level"), "known")
    ends = stash(at.where("k = 0").select("conv_id", F.col("id").alias("anchor"), F.lit(0).cast("long").alias("base")), "call-ends")
    while True:  # a round for each call of several needs on the longest way
        new = open_.join(ends, ["conv_id", "anchor"], "left").groupBy("conv_id", "id").agg(F.max(F.col("steps") + F.col("base") + 1).alias("base"), F.count_if(F.col("base").isNull() | ~F.col("done")).alias("missing"))
        new = stash(new.where("missing = 0").select("conv_id", F.col("id").alias("anchor"), "base"), "call-ends")
        if not new.take(1):
            break
        ends = stash(ends.unionByName(new), "call-ends")
        open_ = stash(open_.join(new.select("conv_id", F.col("anchor").alias("id")), ["conv_id", "id"], "left_anti"), "call-joins")
    out = at.join(ends, ["conv_id", "anchor"], "left")
    return out.select("conv_id", "id", F.when(F.col("done"), F.col("steps") + F.col("base")).alias("level"), "known")


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, call_id, turn, name, level, result_turn, answered, valid, canonical for each call."""
    told = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", "role").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    told = stash(told, "messages")
    calls, answers = calls_of(told, schemas or SCHEMAS)
    both = calls.join(levels(calls), ["conv_id", "id"]).join(results_of(told, answers), ["conv_id", "id"], "left")
    # arguments are JSON already; the rest of the object is written around them
    rest = F.to_json(F.struct("id", F.col("level"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    canonical = F.concat(F.lit('{"arguments":'), "arguments", F.lit(","), F.substring(rest, 2, 2147483647))
    valid = F.col("fit") & F.col("known") & F.col("level").isNotNull()
    return both.select("conv_id", F.col("id").alias("call_id"), "turn", "name", "level", "result_turn", F.col("result_turn").isNotNull().alias("answered"), valid.alias("valid"), canonical.alias("canonical"))


def with_tools(messages: DataFrame) -> DataFrame:
    """messages with tool calls made of their user turns, some of them faulty in one way or another, and results of half of these."""
    said = messages.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.expr("pmod(conv_id + turn div 2, 6)").alias("kind")).distinct()
    q, n = "'\"query\":\"q', conv_id, '\"'", "turn"
    arguments = F.expr(f"""CASE kind WHEN 1 THEN concat('{{', {q}, ',"limit":"', {n}, '"}}') WHEN 2 THEN concat('{{"limit":', {n}, '}}') WHEN 3 THEN concat('{{"limit":', {n}, ', "extra": true, ', {q}, '}}')
        WHEN 5 THEN concat('{{"limit":1, "filters": {{"b":[1,2],"a":null}}, ', {q}, '}}') ELSE concat('{{', {q}, ', "limit": ', {n}, '}}') END""")
    need = F.expr("""CASE WHEN turn = 0 AND conv_id % 10 = 7 THEN '"c0"' WHEN kind = 5 AND turn >= 4 THEN concat('["c', turn - 2, '","c', turn - 4, '"]') WHEN turn >= 2 THEN concat('["c', turn - 2, '"]') ELSE 'null' END""")
    call = F.concat(F.lit('{"tool_calls": [{"id": "c'), F.col("turn"), F.lit('", "name": "'), F.when(F.col("kind") == 4, "unknown").otherwise("search"), F.lit('", "arguments": '), arguments, F.lit(', "after": '), need, F.lit("}]}"))
    calls = said.select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    answer = F.concat(F.lit('{"tool_call_id": "c'), F.col("turn"), F.lit('", "content": "r'), F.col("turn"), F.lit('"}'))
    tools = said.where("turn % 4 = 0").select("conv_id", (F.col("turn") + 1).cast(said.schema["turn"].dataType).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(calls).unionByName(tools)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(with_tools(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", "turn", "name", F.col("level").cast("long").alias("level"), "result_turn", "answered", "valid", F.sha2("canonical", 256).alias("canonical_sha256"))


SQL = r"""
WITH m AS (SELECT conv_id, turn, role, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
o AS (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
u AS (SELECT conv_id, turn, text AS prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level, CASE WHEN next_role = 'assistant' THEN next_turn END AS result_turn, CASE WHEN next_role = 'assistant' THEN next_text END AS content FROM o WHERE role = 'user'),
s AS (SELECT conv_id, turn, ((conv_id + turn // 2) % 6 + 6) % 6 AS kind, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, count(*) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) > 0 AS has2, count(*) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) > 0 AS has4 FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS place, min(turn) OVER (PARTITION BY conv_id, turn % 2, run) = 0 AND conv_id % 10 = 7 AS cyclic FROM s),
c AS (SELECT *, CASE WHEN NOT cyclic THEN place END AS level, CASE kind WHEN 1 THEN '{"limit":"' || turn || '","query":"q' || conv_id || '"}' WHEN 2 THEN '{"limit":' || turn || '}' WHEN 3 THEN '{"extra":true,"limit":' || turn || ',"query":"q' || conv_id || '"}'
   WHEN 5 THEN '{"filters":{"a":null,"b":[1,2]},"limit":1,"query":"q' || conv_id || '"}' ELSE '{"limit":' || turn || ',"query":"q' || conv_id || '"}' END AS arguments, CASE WHEN kind = 4 THEN 'unknown' ELSE 'search' END AS name FROM t),
every AS (
SELECT conv_id, 'turn-' || turn AS call_id, turn, 'reply' AS name, level, result_turn, true AS valid, '{"prompt":' || to_json(prompt)::VARCHAR || '}' AS arguments, content FROM u
UNION ALL SELECT conv_id, 'c' || turn, turn, name, level, CASE WHEN turn % 4 = 0 THEN turn + 1 END, kind IN (0, 5) AND level IS NOT NULL AND (turn < 2 OR has2) AND (kind <> 5 OR turn < 4 OR has4), arguments, CASE WHEN turn % 4 = 0 THEN 'r' || turn END FROM c)
SELECT conv_id, call_id, turn, name, level, result_turn, result_turn IS NOT NULL AS answered, valid,
  sha256('{"arguments":' || arguments || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS canonical_sha256
FROM every
"""
QUERIES, ORACLE = {"op3_tool_calls": op3_tool_calls}, {"op3_tool_calls": SQL}
