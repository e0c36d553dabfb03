"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message's text may be a JSON object with `tool_calls` (each with `id`, `name` and `arguments`, an
object or its JSON text; also under `function`), or, for the role `tool`, with `tool_call_id`; a
`tools` list (`name` and `parameters`, a JSON schema) declares tools. Any other text is content.

1. Calls and results are exploded and hash-joined on (conversation, id); of calls with one id the
   first is linked, later ones count as repeated.
2. Messages stand in topological order: a result after its call, all else as in its turns. Kahn's
   algorithm that takes the least turn that is free gives exactly the order by (the later of own and
   call's turn, late, own turn), so it is a sort key and nothing walks a graph.
3. Arguments are validated against the schema declared for the name in the conversation. A keyword
   of the schema that is malformed (a pattern that doesn't compile, a bound that is no number) is an
   error of the call. Patterns are searched for in time that grows with the text alone (`found_in`).
4. Each conversation is a JSON array with sorted keys and no spaces, cut into parts where its messages
   in order, each counted with MESSAGE bytes more, pass a multiple of PART_BYTES; so most have part 0
   only. Messages are sorted by ranges of (conversation, order), so no task gathers a conversation,
   and the parts of one, laid end to end, are in topological order whatever its size.

Defined cases: a message with a null conv_id is a conversation of its own; a null turn stands last;
a null role is ""; a null text is an empty content; repeated rows are messages of their own; bad
JSON, with NaN, Infinity, numbers beyond a double or nested too deep, is content; half a surrogate
pair is written as its escape; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.runtime import stage, table

PART_BYTES = 16 << 20
MESSAGE = 4096
#: Rows of one range of the sort, about.
RANGE_ROWS = 50_000
TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}
HALF = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return text if text.isascii() else HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def read_json(text: str):
    """The value of strict JSON; ValueError for anything else, and for what can't be written again."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def same(a, b) -> bool:
    """Equal as JSON: true isn't 1."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def is_a(value, kind: str) -> bool:
    if kind in ("integer", "number") and isinstance(value, bool):
        return False
    return isinstance(value, TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def schema_errors(value, schema, path: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, const, required, properties, additionalProperties, items and bounds.

    A malformed keyword is one error more, and is not applied.
    """
    if schema is True or schema is None:
        return []
    if schema is False:
        return [f"{path}: nothing is allowed"]
    if not isinstance(schema, dict):
        return [f"{path}: malformed schema"]
    out: list[str] = []

    def keyword(name: str, fits) -> object:
        given = schema.get(name)
        if name in schema and not fits(given):
            out.append(f"{path}: malformed {name}")
            return None
        return given

    kinds = keyword("type", lambda t: all(isinstance(k, str) and k in TYPES for k in (t if isinstance(t, list) else [t])) and t != [])
    if kinds is not None and not any(is_a(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{path}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"]
    among = keyword("enum", lambda e: isinstance(e, list))
    if among is not None and not any(same(value, e) for e in among):
        out.append(f"{path}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{path}: not the constant")
    known = keyword("properties", lambda d: isinstance(d, dict)) or {}
    required = keyword("required", lambda r: isinstance(r, list) and all(isinstance(k, str) for k in r)) or []
    others = keyword("additionalProperties", lambda d: isinstance(d, (bool, dict)))
    if isinstance(value, dict):
        out += [f"{path}.{k}: missing" for k in required if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{path}.{k}")
            elif others is False:
                out.append(f"{path}.{k}: not declared")
            elif isinstance(others, dict):
                out += schema_errors(value[k], others, f"{path}.{k}")
    items = keyword("items", lambda d: isinstance(d, (bool, dict)))
    if isinstance(value, list) and items is not None:
        for k, item in enumerate(value):
            out += schema_errors(item, items, f"{path}[{k}]")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (None, "minimum", "maximum")):
        least, most = keyword(low, is_number), keyword(high, is_number)
        if is_number(value) if kind is None else isinstance(value, kind):
            size = value if kind is None else len(value)
            out += [f"{path}: against {low}"] if least is not None and size < least else []
            out += [f"{path}: against {high}"] if most is not None and size > most else []
    pattern = keyword("pattern", compiles)
    if pattern is not None and isinstance(value, str) and not found_in(pattern, value):
        out.append(f"{path}: against pattern")
    return out


def compiles(pattern) -> bool:
    try:
        re.compile(pattern)
    except (TypeError, re.error, OverflowError, RecursionError):
        return False
    return isinstance(pattern, str)


def found_in(pattern: str, text: str) -> bool:
    """Whether the text holds the pattern, by an engine whose time grows with the text alone.

    It knows no look-arounds and back references: such patterns are searched for PATTERN_SECONDS at most, after which the text counts as against them.
    """
    try:
        return pc.match_substring_regex(pa.array([HALF.sub("\ufffd", text)]), HALF.sub("\ufffd", pattern))[0].as_py()
    except pa.ArrowInvalid:
        try:
            return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None
        except (TimeoutError, regex.error):
            return False


PATTERN_SECONDS = 0.5


def call_errors(arguments: str, schema: str | None) -> int:
    """How many ways the arguments of a call break its schema; none without one, one more if it can't be told."""
    if schema is None:
        return 0
    try:
        return len(schema_errors(json.loads(arguments), json.loads(schema)))
    except RecursionError:
        return 1


def parsed(role: str | None, text: str | None) -> dict:
    """content, calls [(id, name, arguments)], result_id, tools [(name, schema)] of one message; arguments and schemas as canonical JSON."""
    out = {"content": text or "", "calls": [], "result_id": None, "tools": []}
    if not text or text.lstrip()[:1] != "{":
        return out
    try:
        body = read_json(text)
    except ValueError:
        return out
    calls, tools = body.get("tool_calls"), body.get("tools")
    result = body.get("tool_call_id")
    if isinstance(calls, list):
        for call in calls:
            own = call.get("function", call) if isinstance(call, dict) else None
            if isinstance(own, dict):
                arguments = own.get("arguments", {})
                if isinstance(arguments, str):
                    try:
                        arguments = read_json(arguments)
                    except ValueError:
                        pass
                out["calls"].append((None if call.get("id") is None else named(call["id"]), named(own.get("name") or ""), canonical(arguments)))
    if isinstance(tools, list):
        for tool in tools:
            own = tool.get("function", tool) if isinstance(tool, dict) else None
            if isinstance(own, dict) and own.get("name"):
                out["tools"].append((named(own["name"]), canonical({} if own.get("parameters") is None else own["parameters"])))
    if role == "tool" and result is not None:
        out["result_id"] = named(result)
    if out["calls"] or out["tools"] or out["result_id"] is not None:
        content = body.get("content", "")
        out["content"] = content if isinstance(content, str) else canonical(content)
    return out


def named(value) -> str:
    """An identifier or name as text; what isn't text is its JSON."""
    return HALF.sub("�", value) if isinstance(value, str) else canonical(value)


def message_json(role: str | None, found: dict) -> str:
    """One message as canonical JSON."""
    message = {"role": role or "", "content": found["content"]}
    if found["calls"]:
        message["tool_calls"] = [{"id": i, "name": n, "arguments": json.loads(a)} for i, n, a in found["calls"]]
    if found["tools"]:
        message["tools"] = [{"name": n, "parameters": json.loads(s)} for n, s in found["tools"]]
    if found["result_id"] is not None:
        message["tool_call_id"] = found["result_id"]
    return canonical(message)


def messages(chats: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, rid, message, calls, result_id, tools): every message read once."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    pairs, triples = pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])), pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))

    def run(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            found = [parsed(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv", "conv_id", "turn", "rid")),
                    pa.array([message_json(r, f) for r, f in zip(roles, found, strict=True)], pa.string()),
                    pa.array([[dict(zip(("id", "name", "arguments"), c, strict=True)) for c in f["calls"]] for f in found], triples),
                    pa.array([f["result_id"] for f in found], pa.string()),
                    pa.array([[{"name": n, "schema": s} for n, s in f["tools"]] for f in found], pairs),
                ],
                names=["conv", "conv_id", "turn", "rid", "message", "calls", "result_id", "tools"],
            )

    named = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("m"), F.col("rid").cast("string")))
    return named.withColumn("conv", conv).mapInArrow(
        run, f"conv string, conv_id {kind}, turn long, rid long, message string, calls array<struct<id:string,name:string,arguments:string>>, result_id string, tools array<struct<name:string,schema:string>>"
    )


def validated(calls: DataFrame) -> DataFrame:
    """Adds `errors` to (arguments, schema) rows: how many ways the arguments break the schema; none without a schema."""

    def run(batches):
        for batch in batches:
            errors = []
            for arguments, schema in zip(batch.column("arguments").to_pylist(), batch.column("schema").to_pylist(), strict=True):
                errors.append(call_errors(arguments, schema))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.int64())], names=[*batch.schema.names, "errors"])

    schema = calls.sparkSession.createDataFrame([], calls.schema).withColumn("errors", F.lit(0).cast("long")).schema
    return calls.mapInArrow(run, schema)


def chat_format(chats: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, n_messages, n_calls, n_linked, n_unanswered, n_repeated, n_orphans, n_invalid, usable, messages."""
    found = stage(messages(chats), "messages")
    place = F.struct(F.col("turn").isNull().alias("none"), F.col("turn"), F.col("rid"))
    calls = found.select("conv", "rid", "turn", F.posexplode("calls").alias("k", "call")).select("conv", "rid", "turn", "k", "call.id", "call.name", "call.arguments")
    first = calls.where("id IS NOT NULL").groupBy("conv", "id").agg(F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "rid", "k")).alias("at"))
    results = found.where("result_id IS NOT NULL").select("conv", F.col("result_id").alias("id"), "rid")
    answers = results.groupBy("conv", "id").agg(F.lit(True).alias("answered"))
    declared = (
        found.select("conv", place.alias("at"), F.explode("tools").alias("tool")).groupBy("conv", F.col("tool.name").alias("name"))
        .agg(F.min_by("tool.schema", "at").alias("schema"))
    )
    checked = validated(calls.join(declared, ["conv", "name"], "left").select("conv", "rid", "k", "id", "arguments", "schema"))
    linked = checked.join(first, ["conv", "id"], "left").join(answers, ["conv", "id"], "left")
    leads = (F.col("at.rid") == F.col("rid")) & (F.col("at.k") == F.col("k"))
    by_message = linked.groupBy("rid").agg(
        F.count("*").alias("n_calls"),
        F.count_if(leads & F.coalesce("answered", F.lit(False))).alias("n_linked"),
        F.count_if(F.coalesce(leads, F.lit(True)) & ~F.coalesce("answered", F.lit(False))).alias("n_unanswered"),
        F.count_if(~F.coalesce(leads, F.lit(True))).alias("n_repeated"),
        F.count_if(F.col("errors") > 0).alias("n_invalid"),
    )
    call_turn = results.join(first.select("conv", "id", F.struct("at.none", "at.turn").alias("call_at")), ["conv", "id"], "left").select("rid", "call_at", F.lit(True).alias("is_result"))
    own = F.struct(F.col("turn").isNull().alias("none"), F.col("turn"))
    ordered = (
        found.select("conv", "conv_id", "turn", "rid", "message").join(by_message, "rid", "left").join(call_turn, "rid", "left")
        .withColumn("slot", F.greatest(own, F.coalesce("call_at", own)))
        .withColumn("late", F.coalesce(F.col("call_at") >= own, F.lit(False)))
        .withColumn("orphan", F.coalesce(F.col("is_result") & F.col("call_at").isNull(), F.lit(False)))
    )
    order = ["slot", "late", "turn", "rid"]
    ranges = max(1, -(-found.count() // RANGE_ROWS))
    # Staged, as ranges are drawn from a sample: `range` numbers what each task of the sort holds.
    ordered = stage(ordered.repartitionByRange(ranges, "conv", *order).withColumn("range", F.spark_partition_id()), "ordered-messages")
    weight = F.octet_length("message") + F.lit(MESSAGE)
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ordered.groupBy("conv", "range").agg(F.sum(weight).alias("bytes"))
        .select("conv", "range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    )
    own_bytes = F.coalesce(F.sum(weight).over(Window.partitionBy("conv", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = ordered.withColumn("own", own_bytes).join(before, ["conv", "range"]).withColumn("part", F.expr(f"(before + own) div {part_bytes}"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = pieces.groupBy("conv", "conv_id", "part").agg(
        F.count("*").alias("n_messages"), *[total(c) for c in ("n_calls", "n_linked", "n_unanswered", "n_repeated", "n_invalid")], F.count_if("orphan").alias("n_orphans"),
        F.array_sort(F.collect_list(F.struct(*order, "message"))).alias("rows"),
    )
    return whole.select(
        "conv_id", "part", "n_messages", "n_calls", "n_linked", "n_unanswered", "n_repeated", "n_orphans", "n_invalid",
        (F.col("n_unanswered") + F.col("n_repeated") + F.col("n_orphans") + F.col("n_invalid") == 0).alias("usable"),
        F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["message"]), ","), F.lit("]")).alias("messages"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: The same in DuckDB for conversations without tool calls, as all of the table's are, and of at most PART_BYTES.
OP8_SQL = """
SELECT conv_id, 0::BIGINT AS part, count(*) AS n_messages, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked,
       0::BIGINT AS n_unanswered, 0::BIGINT AS n_repeated, 0::BIGINT AS n_orphans, 0::BIGINT AS n_invalid, true AS usable,
       '[' || string_agg('{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, ''))::VARCHAR || '}', ',' ORDER BY turn) || ']' AS messages
FROM conversations GROUP BY conv_id
"""

#: Schema that the conversations of `chat_tool_calls` declare.
LOOK_UP = '{"type":"object","required":["n"],"properties":{"n":{"type":"integer","maximum":1200},"first":{"type":"string","pattern":"[a-z ]"}},"additionalProperties":false}'


def with_calls(chats: DataFrame) -> DataFrame:
    """Every message of (conv_id, turn, role, text) made one with tool calls, for the query below: turn 0 declares a tool, assistants call it, users' messages after them are results.

    Every fifth conversation calls under one id (repeats), every third answers the next id (orphans),
    every fourth has its results before the calls, every seventh calls with a field not declared.
    """
    own = F.when(F.expr("conv_id % 5 = 0"), F.lit("c1")).otherwise(F.concat(F.lit("c"), F.col("turn").cast("string")))
    answered = F.when(F.expr("conv_id % 5 = 0"), F.lit("c1")).otherwise(F.concat(F.lit("c"), F.expr("turn - if(conv_id % 3 = 0, 0, 1)").cast("string")))
    fields = F.struct(F.length("text").alias("n"), F.left("text", F.lit(5)).alias("first"), F.when(F.expr("conv_id % 7 = 0"), F.lit(1)).alias("more"))
    calls = F.to_json(F.struct(F.col("text").alias("content"), F.array(F.struct(own.alias("id"), F.struct(F.lit("look_up").alias("name"), F.to_json(fields).alias("arguments")).alias("function"))).alias("tool_calls")))
    results = F.to_json(F.struct(answered.alias("tool_call_id"), F.col("text").alias("content")))
    tools = F.concat(F.lit('{"tools":[{"name":"look_up","parameters":' + LOOK_UP + '}],"content":'), F.element_at(F.split(F.to_json(F.struct(F.col("text").alias("t"))), ":", 2), 2))
    kind = F.when(F.col("turn") == 0, "system").when(F.col("role") == "assistant", "assistant").otherwise("tool")
    text = F.when(F.col("turn") == 0, tools).when(F.col("role") == "assistant", calls).otherwise(results)
    turn = F.expr("10 * turn - if(turn > 0 AND role <> 'assistant' AND conv_id % 4 = 0, 15, 0)")
    return chats.select("conv_id", turn.cast("long").alias("turn"), kind.alias("role"), text.alias("text"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of messages that hold calls, results and schemas, made of the table's own."""
    return chat_format(with_calls(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


CALLS_SQL = """
WITH m AS (
  SELECT conv_id, turn AS t, text, CASE WHEN turn = 0 THEN 'system' WHEN role = 'assistant' THEN 'assistant' ELSE 'tool' END AS kind,
         10 * turn - CASE WHEN turn > 0 AND role <> 'assistant' AND conv_id % 4 = 0 THEN 15 ELSE 0 END AS turn FROM conversations),
i AS (
  SELECT *, CASE WHEN kind = 'system' THEN NULL WHEN conv_id % 5 = 0 THEN 'c1'
                 WHEN kind = 'assistant' OR conv_id % 3 = 0 THEN 'c' || t ELSE 'c' || (t - 1) END AS id FROM m),
f AS (SELECT conv_id, id, min(turn) AS called FROM i WHERE kind = 'assistant' GROUP BY conv_id, id),
r AS (SELECT DISTINCT conv_id, id, true AS answered FROM i WHERE kind = 'tool'),
d AS (SELECT DISTINCT conv_id, true AS declared FROM i WHERE kind = 'system'),
x AS (
  SELECT i.*, f.called, coalesce(r.answered, false) AS answered,
         coalesce(d.declared, false) AND (length(text) > 1200 OR conv_id % 7 = 0 OR NOT regexp_matches(left(text, 5), '[a-z ]')) AS broken,
         CASE WHEN kind = 'tool' THEN greatest(turn, coalesce(f.called, turn)) ELSE turn END AS slot,
         CASE WHEN kind = 'tool' THEN coalesce(f.called >= turn, false) ELSE false END AS late
  FROM i LEFT JOIN f USING (conv_id, id) LEFT JOIN r USING (conv_id, id) LEFT JOIN d USING (conv_id)),
j AS (
  SELECT *, '{"content":' || to_json(text)::VARCHAR || ',"role":"' || kind || '"' ||
    CASE kind WHEN 'tool' THEN ',"tool_call_id":"' || id || '"}'
      WHEN 'system' THEN ',"tools":[{"name":"look_up","parameters":{"additionalProperties":false,"properties":{"first":{"pattern":"[a-z ]","type":"string"},"n":{"maximum":1200,"type":"integer"}},"required":["n"],"type":"object"}}]}'
      ELSE ',"tool_calls":[{"arguments":{"first":' || to_json(left(text, 5))::VARCHAR || CASE WHEN conv_id % 7 = 0 THEN ',"more":1' ELSE '' END || ',"n":' || length(text) || '},"id":"' || id || '","name":"look_up"}]}' END AS message FROM x),
g AS (
  SELECT conv_id, 0::BIGINT AS part, count(*) AS n_messages, count(*) FILTER (kind = 'assistant') AS n_calls,
    count(*) FILTER (kind = 'assistant' AND turn = called AND answered) AS n_linked, count(*) FILTER (kind = 'assistant' AND turn = called AND NOT answered) AS n_unanswered,
    count(*) FILTER (kind = 'assistant' AND turn <> called) AS n_repeated, count(*) FILTER (kind = 'tool' AND called IS NULL) AS n_orphans,
    count(*) FILTER (kind = 'assistant' AND broken) AS n_invalid, '[' || string_agg(message, ',' ORDER BY slot, late, turn) || ']' AS messages
  FROM j GROUP BY conv_id)
SELECT *, n_unanswered + n_repeated + n_orphans + n_invalid = 0 AS usable FROM g
"""
