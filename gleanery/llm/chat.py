"""Chat formatting: tool calls linked to results, checked and serialised.

DataFrame functions only. An assistant turn whose text is a JSON object with
``tool_calls`` (id, name, arguments) makes calls; a turn of role ``tool``
whose text is an object with ``tool_call_id`` is a result. Arguments may name
another call's result as ``"$call:<id>"``. Messages come out one by one, each
with its place in a topological order: no conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string>>"
#: Parameters of known tools: type and whether they must be given.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "timeout": ("number", False), "headers": ("object", False)},
}
#: JSON type to the pattern of what Spark calls the type of a parsed value.
TYPES = {"string": "^STRING", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def _known(tools: dict) -> Column:
    """The tools as a literal map: name to parameter to (pattern, needed)."""
    one = lambda params: F.create_map(*[c for p, (kind, needed) in sorted(params.items()) for c in (F.lit(p), F.struct(F.lit(TYPES[kind]).alias("pattern"), F.lit(needed).alias("needed")))])
    return F.create_map(*[c for name, params in sorted(tools.items()) for c in (F.lit(name), one(params))])


def arguments_valid(name: Column, arguments: Column, tools: dict) -> Column:
    """Whether arguments fit the tool's schema; unknown tools and broken JSON don't."""
    given = F.try_parse_json(arguments)
    kinds = F.transform_values(given.try_cast("map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    schema = F.try_element_at(_known(tools), name)
    fits = F.forall(F.map_entries(kinds), lambda e: F.coalesce(F.regexp_like(e["value"], F.try_element_at(schema, e["key"])["pattern"]), F.lit(False)))
    whole = F.forall(F.map_entries(schema), lambda e: ~e["value"]["needed"] | F.array_contains(F.map_keys(kinds), e["key"]))
    return F.coalesce(F.schema_of_variant(given).startswith("OBJECT") & fits & whole, F.lit(False))


def _anchors(calls: DataFrame) -> DataFrame:
    """(conv_id, id, to, dist, at): calls of one reference, and the first call up their chain that has none or several.

    Pointers jump to where the call they point at points, so a chain of n
    calls takes log n rounds. What is on a cycle, behind one, or behind a
    reference to nothing is left out. ``at`` is the latest turn on the way.
    """
    targets = calls.select("conv_id", F.col("id").alias("to"), "result_turn", (F.size("refs") == 1).alias("onward"))
    one = calls.where(F.size("refs") == 1).select("conv_id", "id", F.col("refs")[0].alias("to"), "turn")
    now = cut(one.join(targets, ["conv_id", "to"]).select("conv_id", "id", "to", F.lit(1).alias("dist"), F.greatest("turn", "result_turn").alias("at"), "onward"))
    for _ in range(now.count().bit_length() + 1):
        if now.where("onward").isEmpty():
            break
        step = now.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("at").alias("later"), F.col("onward").alias("still"))
        moved = now.where("onward").join(step, ["conv_id", "to"]).select("conv_id", "id", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.greatest("at", "later").alias("at"), F.col("still").alias("onward"))
        now = cut(now.where("NOT onward").unionByName(moved))
    return now.where("NOT onward").drop("onward")


def _ordered(calls: DataFrame) -> DataFrame:
    """Calls with ``level`` and ``at``, in topological order.

    A call takes its turn, or the latest turn of what it refers to if that is
    later. Calls on a cycle, or behind one, or with a reference to nothing
    keep a null level. Chains of single references are jumped over; calls of
    several are peeled off in rounds, as many as the longest chain of these.
    """
    calls = cut(calls)
    known = calls.where(F.size("refs") == 0).select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("at"))
    if not calls.where(F.size("refs") > 0).isEmpty():
        anchors = _anchors(calls)
        ends = calls.where(F.size("refs") != 1).select("conv_id", F.col("id").alias("ref"), F.col("id").alias("to"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("on_way"))
        ends = ends.unionByName(anchors.select("conv_id", F.col("id").alias("ref"), "to", "dist", F.col("at").cast("long").alias("on_way")))
        many = calls.where(F.size("refs") > 1).select("conv_id", "id", "turn", F.size("refs").alias("n"), F.explode("refs").alias("ref"))
        wants = cut(many.join(calls.select("conv_id", F.col("id").alias("ref"), "result_turn"), ["conv_id", "ref"]).join(ends, ["conv_id", "ref"]))
        known = cut(known)
        while not wants.isEmpty():
            ready = wants.join(known.select("conv_id", F.col("id").alias("to"), "level", "at"), ["conv_id", "to"])
            ready = ready.groupBy("conv_id", "id", "turn", "n").agg(F.count_distinct("ref").alias("have"), (F.max(F.col("level") + F.col("dist")) + 1).alias("level"), F.max(F.greatest("at", "on_way", "result_turn")).alias("at"))
            fresh = cut(ready.where("have = n").select("conv_id", "id", "level", F.greatest("turn", "at").alias("at")))
            if fresh.isEmpty():
                break
            known, wants = cut(known.unionByName(fresh)), cut(wants.join(fresh.select("conv_id", "id"), ["conv_id", "id"], "left_anti"))
        chained = anchors.withColumnRenamed("at", "on_way").join(known.select("conv_id", F.col("id").alias("to"), "level", "at"), ["conv_id", "to"])
        known = known.unionByName(chained.select("conv_id", "id", (F.col("level") + F.col("dist")).alias("level"), F.greatest("on_way", "at").alias("at")))
    return calls.join(known, ["conv_id", "id"], "left").withColumn("at", F.coalesce("at", "turn"))


def _plain(role: Column, content: Column, turn: Column) -> Column:
    return F.to_json(F.struct(content.alias("content"), role.alias("role"), turn.alias("turn")), {"ignoreNullFields": "false"})


def format_chat(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row for each message: (conv_id, turn, role, at, level, n_calls, n_linked, n_valid, linked, json).

    Messages of a conversation in topological order are those by (at, level,
    turn). ``level`` is 0 for plain messages and first calls, odd for results,
    null for calls that cannot be ordered. ``json`` has sorted keys and no
    white space. Of calls or results that repeat an identifier in one
    conversation the first by turn counts. White space before an object does
    not matter. Texts that are no JSON objects, and null roles and texts, are plain messages; rows without conv_id or call
    identifier are never linked. Repeated rows stay. An empty table gives no
    rows; other columns are not looked at.
    """
    tools = TOOLS if tools is None else tools
    m = messages.select("conv_id", "turn", "role", "text")
    has = F.coalesce(F.col("text").rlike(r"^[\x20\t\r\n]*\{"), F.lit(False))
    is_call = F.coalesce(has & (F.col("role") == "assistant") & F.col("text").contains('"tool_calls"'), F.lit(False))
    is_result = F.coalesce(has & (F.col("role") == "tool") & F.col("text").contains('"tool_call_id"'), F.lit(False))
    plain = m.where(~is_call & ~is_result).select(
        "conv_id", "turn", "role", F.col("turn").alias("at"), F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_linked", "n_valid")], F.lit(False).alias("linked"), _plain(F.col("role"), F.col("text"), F.col("turn")).alias("json")
    )
    callers = m.where(is_call).withColumn("list", F.from_json("text", CALLS)["tool_calls"]).withColumn("content", F.get_json_object("text", "$.content"))
    results = m.where(is_result).withColumn("got", F.from_json("text", "tool_call_id string, content string"))

    first = F.min(F.struct("turn", "name", "arguments"))
    calls = callers.select("conv_id", "turn", F.explode("list").alias("c")).select("conv_id", "turn", "c.*").where("conv_id IS NOT NULL AND id IS NOT NULL")
    calls = calls.groupBy("conv_id", "id").agg(first.alias("c")).select("conv_id", "id", "c.*")
    answers = results.select("conv_id", F.col("got.tool_call_id").alias("id"), "turn").where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    calls = (
        calls.hint("shuffle_hash")
        .join(answers, ["conv_id", "id"], "left")
        .withColumn("valid", arguments_valid(F.col("name"), F.col("arguments"), tools))
        .withColumn("refs", F.coalesce(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$call:([^"]+)"'), 1)), F.array().cast("array<string>")))
    )
    ordered = _ordered(calls)

    known = ordered.select("conv_id", "id", "valid", "level", "at", F.col("result_turn").isNotNull().alias("linked"), "name")
    own = callers.withColumn("key", F.md5(F.to_json(F.struct("conv_id", "turn", "text"))))
    each = own.select("key", "conv_id", F.posexplode_outer("list").alias("pos", "c")).distinct().withColumn("id", F.col("c.id")).join(known, ["conv_id", "id"], "left")
    shown = F.struct(F.to_json(F.try_parse_json("c.arguments")).alias("arguments"), F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.coalesce("valid", F.lit(False)).alias("valid"))
    per = each.groupBy("key").agg(
        F.count("c").alias("n_calls"),
        F.count_if("linked").alias("n_linked"),
        F.count_if("valid").alias("n_valid"),
        F.when(F.count_if(F.col("c").isNotNull() & F.col("level").isNull()) == 0, F.coalesce(F.max("level"), F.lit(0)) * 2).alias("level"),
        F.max("at").alias("at"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("c")))), lambda x: x["c"]).alias("calls"),
    )
    quoted = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})) - 6)
    call_json = F.transform("calls", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(c["arguments"], F.lit("null")), F.lit(',"id":'), quoted(c["id"]), F.lit(',"name":'), quoted(c["name"]), F.lit(',"valid":'), c["valid"].cast("string"), F.lit("}")))
    body = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":"assistant","tool_calls":['), F.array_join(call_json, ","), F.lit('],"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    spoken = own.join(per, "key").select("conv_id", "turn", "role", F.greatest("turn", "at").alias("at"), "level", "n_calls", "n_linked", "n_valid", F.lit(False).alias("linked"), body.alias("json"))

    given = results.withColumn("id", F.col("got.tool_call_id")).join(known.select("conv_id", "id", "name", "level", F.col("at").alias("call_at"), F.lit(True).alias("linked")), ["conv_id", "id"], "left")
    told = F.to_json(F.struct(F.col("got.content").alias("content"), F.col("name"), F.col("role"), F.col("id").alias("tool_call_id"), F.col("turn")), {"ignoreNullFields": "false"})
    told = given.select(
        "conv_id", "turn", "role", F.greatest("turn", "call_at").alias("at"), F.when(F.col("linked"), F.col("level") * 2 + 1).otherwise(1).alias("level"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_linked", "n_valid")], F.coalesce("linked", F.lit(False)).alias("linked"), told.alias("json"),
    )
    return plain.unionByName(spoken).unionByName(told)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``, linked, placed and serialised."""
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For turns that are plain messages, as all of this table's are; linked calls are tested against a plain Python version.
SQL = """
SELECT conv_id, turn, role, turn AS "at", 0 AS level, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid, false AS linked,
  to_json({'content': text, 'role': role, 'turn': turn})::VARCHAR AS json
FROM conversations
"""
