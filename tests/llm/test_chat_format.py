import heapq
import json
import random
import time
from collections import defaultdict

from quillmesh.llm import chat_format as cf

TOOL = {"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x"]}}, "additionalProperties": False}}


def call(i, **arguments):
    return json.dumps({"content": "hm", "tool_calls": [{"id": i, "name": "add", "arguments": arguments}]})


def result(i, value="1"):
    return json.dumps({"tool_call_id": i, "content": value})


def kahn(rows):
    """Messages of one conversation in topological order, the least turn that is free first."""
    found = [cf.parsed(r, t) for _, r, t in rows]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0], k)):
        for i, _, _ in found[k]["calls"]:
            first.setdefault(i, k)
    after, waits = defaultdict(list), [0] * len(rows)
    for k, f in enumerate(found):
        if f["result_id"] in first:
            after[first[f["result_id"]]].append(k)
            waits[k] += 1
    heap = [(rows[k][0], k) for k in range(len(rows)) if not waits[k]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, k = heapq.heappop(heap)
        out.append(cf.message_json(rows[k][1], found[k]))
        for n in after[k]:
            waits[n] -= 1
            heapq.heappush(heap, (rows[n][0], n))
    return "[" + ",".join(out) + "]"


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)


def test_links_validation_and_counts(spark):
    system = json.dumps({"tools": [TOOL], "content": "use tools"})
    rows = [
        (1, 0, "system", system), (1, 1, "user", "hi {"), (1, 2, "assistant", call("c1", a=1, b="x")), (1, 3, "tool", result("c1")),
        (2, 0, "system", system), (2, 1, "assistant", call("c1", a=-1)), (2, 2, "assistant", call("c1", a=1)), (2, 3, "tool", result("zz")), (2, 4, "assistant", call("c2", z=1)),
        (3, 0, "user", '{"b": 1, "a": "\\u00e9"}'),
    ]
    got = {r.conv_id: r for r in cf.chat_format(frame(spark, rows)).collect()}
    assert (got[1].n_calls, got[1].n_linked, got[1].n_invalid, got[1].n_orphans, got[1].usable) == (1, 1, 0, 0, True)
    assert (got[2].n_calls, got[2].n_linked, got[2].n_unanswered, got[2].n_repeated, got[2].n_orphans, got[2].n_invalid, got[2].usable) == (3, 0, 2, 1, 1, 2, False)
    assert got[3].messages == '[{"content":"{\\"b\\": 1, \\"a\\": \\"\\\\u00e9\\"}","role":"user"}]'
    for r in got.values():
        assert cf.canonical(json.loads(r.messages)) == r.messages


def test_schema_errors():
    check = lambda v: len(cf.schema_errors(v, TOOL["parameters"]))
    assert [check(v) for v in ({"a": 1}, {"a": 2.0}, {}, {"a": True}, {"a": -1, "b": "y"}, {"a": 1, "c": 2}, [])] == [0, 0, 1, 1, 2, 1, 1]
    assert len(cf.schema_errors(["a", 1, "bcd"], {"items": {"type": "string", "maxLength": 2}, "maxItems": 2})) == 3


def test_order_equals_kahn(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        n = rng.randint(1, 12)
        turns = list(range(n))
        ids = [f"i{k}" for k in range(3)]
        for t in turns:
            kind = rng.random()
            rows.append((conv, t, *(("assistant", call(rng.choice(ids), a=t)) if kind < 0.35 else ("tool", result(rng.choice(ids))) if kind < 0.75 else ("user", f"t{t}"))))
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[0])
    got = {r.conv_id: r for r in cf.chat_format(frame(spark, rows)).collect()}
    for conv in range(60):
        own = sorted([r[1:] for r in rows if r[0] == conv])
        assert got[conv].messages == kahn(own)
        found = [cf.parsed(r, t) for _, r, t in own]
        calls, answers = [c[0] for f in found for c in f["calls"]], [f["result_id"] for f in found if f["result_id"]]
        linked = len(set(calls) & set(answers))
        expected = (len(calls), linked, len(set(calls)) - linked, len(calls) - len(set(calls)), sum(a not in calls for a in answers))
        assert (got[conv].n_calls, got[conv].n_linked, got[conv].n_unanswered, got[conv].n_repeated, got[conv].n_orphans) == expected


def test_large_conversations_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cf, "RANGE_ROWS", 7)
    rows = [(1, t // 2, "user", f"m{t}") for t in range(40)] + [(2, 0, "user", f"n{t}") for t in range(25)] + [(3, 0, "user", "x")]
    rows += [(4, 10 * t, "assistant", call(f"c{t}", a=t)) for t in range(20)] + [(4, 10 * t - 55, "tool", result(f"c{t}")) for t in range(20)]
    got = cf.chat_format(frame(spark, rows), part_bytes=10 * 4200).collect()
    for conv, n in ((1, 40), (2, 25), (3, 1), (4, 40)):
        parts = [json.loads(r.messages) for r in sorted(got, key=lambda r: r.part) if r.conv_id == conv]
        assert sum(map(len, parts)) == n and max(map(len, parts)) <= 11 and len(parts) >= n // 11
        laid = [m for p in parts for m in p]
        if conv == 1:
            assert [m["content"] for m in laid] == [f"m{t}" for t in range(40)]
        if conv == 4:  # one order over all parts
            assert cf.canonical(laid) == kahn(sorted(r[1:] for r in rows if r[0] == 4))


def test_malformed_schemas_are_errors_of_the_call():
    check = lambda v, s: len(cf.schema_errors(v, s))
    for bad in ({"pattern": "("}, {"pattern": 3}, {"minLength": "5"}, {"maximum": None}, {"required": True}, {"required": [1]}, {"enum": None}, {"type": 5}, {"type": "text"},
                {"type": []}, {"properties": 1}, {"items": "x"}, {"additionalProperties": "no"}, {"maxItems": True}):
        for value in ("x", 1, None, [], {}, {"a": 1}):
            assert check(value, bad) == 1, (bad, value)
    assert [check({}, s) for s in (True, None, False, 3)] == [0, 0, 1, 1]
    assert [check(v, {"enum": [1, "a"]}) for v in (1, True, "a", 1.0)] == [0, 1, 0, 0]
    deep = "[" * 700 + "]" * 700
    schema = '{"items":' * 700 + "{}" + "}" * 700
    assert cf.call_errors(deep, schema) in (0, 1) and cf.call_errors(deep, None) == 0


def test_input_that_broke_programs(spark):
    tools = lambda schema: json.dumps({"tools": [{"name": "add", "parameters": schema}]})
    odd = '{"tool_calls":[{"id":"c","name":"add","arguments":%s}]}'
    texts = [
        odd % '{"a":"\\ud800"}', odd % '"{\\"a\\": NaN}"', odd % '{"a":1e999}', odd % '{"a":NaN}', '{"tool_calls":[{"id":"\\udfff","name":"\\ud800"}]}', "{" * 100_000,
        '{"a":' * 50_000 + "1" + "}" * 50_000, odd % "null", odd % '"[1"', '{"tool_calls":{"id":1}}', '{"tool_calls":[1,null,{"function":3}],"tools":[{"name":3,"parameters":[]}]}', odd % ("9" * 5000),
    ]
    rows = [(k, 0, "system", tools({"type": "object", "pattern": "("})) for k in range(len(texts))] + [(k, 1, "assistant", t) for k, t in enumerate(texts)]
    got = {r.conv_id: r for r in cf.chat_format(frame(spark, rows)).collect()}
    assert sorted(got) == list(range(len(texts)))

    def refuse(name):
        raise AssertionError(name)

    for k, r in got.items():
        messages = json.loads(r.messages, parse_constant=refuse)
        assert len(messages) == r.n_messages == 2
    assert [got[k].n_calls for k in range(len(texts))] == [1, 1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0]
    assert [got[k].n_invalid for k in (0, 1, 7, 8)] == [1, 1, 1, 1]  # the malformed pattern; arguments that are no object


def test_query_keeps_every_message(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    rows = cf.op8_chat_format(spark, sf_dir).collect()
    expected = defaultdict(list)
    for r in source:
        expected[r.conv_id].append({"role": r.role, "content": r.text or ""})
    assert {r.conv_id: json.loads(r.messages) for r in rows} == dict(expected)
    assert all(r.usable and r.n_messages == len(expected[r.conv_id]) for r in rows)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    data = spark.createDataFrame([(None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (1, None, None, None, "x"), (1, 2, "tool", result("q"), "x"), (1, 2, "tool", result("q"), "x"), (2, 0, "assistant", "y" * 300_000, "x")], "conv_id long, turn long, role string, text string, messages string")
    got = sorted((r.conv_id or -1, r.n_messages, r.n_orphans) for r in cf.chat_format(data).collect())
    assert got == [(-1, 1, 0), (-1, 1, 0), (1, 3, 2), (2, 1, 0)]
    assert cf.chat_format(data.limit(0)).count() == 0


def test_patterns_that_backtrack_end():
    text = "a" * 5000 + "b"
    for pattern, found in (("(a+)+$", False), ("(a|aa)+$", False), ("(a*)*b", True), ("^(?:a+)+b$", True), ("\\ud800", False)):
        assert cf.found_in(pattern, text) == found
    began = time.monotonic()
    assert not cf.found_in(r"(?=(a+)+$)(a+)+$", text) and cf.found_in(r"(a)\1", text)
    assert time.monotonic() - began < 10
    assert cf.schema_errors(text, {"pattern": "(a+)+$"}, "$") == ["$: against pattern"]
    assert cf.found_in("x", "\ud800x")
