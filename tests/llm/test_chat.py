"""Linking, order, checks and canonical JSON against hand-made conversations."""

import json
import random

from gleanery.llm.chat import TOOLS, format_chat


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


SCHEMA = "conv_id long, turn long, role string, text string, json string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((r.asDict() for r in format_chat(df).collect()), key=lambda r: (r["conv_id"] or -1, r["at"] or -1, 99 if r["level"] is None else r["level"], r["turn"] or -1))


def test_links_order_and_json(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "search", {"limit": "no"}))),
        (1, 4, "assistant", call(("c", "calculator", '{"expression": "$call:a"}'))),
        (1, 3, "tool", result("b")),
        (1, 5, "tool", result("a", "é")),
        (1, 2, "tool", result("c")),
        (1, 6, "tool", result("zzz")),
    ]
    got = run(spark, rows)
    assert [(r["turn"], r["at"], r["level"]) for r in got] == [(0, 0, 0), (1, 1, 0), (3, 3, 1), (5, 5, 1), (4, 5, 2), (2, 5, 3), (6, 6, 1)]
    by_turn = {r["turn"]: r for r in got}
    assert (by_turn[1]["n_calls"], by_turn[1]["n_linked"], by_turn[1]["n_valid"]) == (2, 2, 1)
    assert by_turn[1]["json"] == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","valid":true},{"arguments":{"limit":"no"},"id":"b","name":"search","valid":false}],"turn":1}'
    assert by_turn[5]["json"] == '{"content":"é","name":"search","role":"tool","tool_call_id":"a","turn":5}'
    assert by_turn[5]["linked"] and not by_turn[6]["linked"]
    for r in got:
        json.loads(r["json"])


def test_cycles_repeats_and_odd_rows(spark):
    loop = [(2, 0, "assistant", call(("p", "fetch", '{"url":"$call:q"}'))), (2, 1, "assistant", call(("q", "fetch", '{"url":"$call:p"}'))), (2, 2, "tool", result("p"))]
    odd = [(None, None, None, None), (3, 0, "assistant", "{broken \"tool_calls\""), (3, 1, "tool", ""), (3, 1, "tool", ""), (None, 1, "tool", result("p")), (4, 0, "assistant", call((None, "fetch", "{}"), ("u", "unknown", "{}"), ("v", "fetch", "not json")))]
    got = run(spark, loop + odd)
    assert len(got) == len(loop + odd)
    assert [r["level"] for r in got if r["conv_id"] == 2 and r["role"] == "assistant"] == [None, None]
    four = next(r for r in got if r["conv_id"] == 4)
    assert (four["n_calls"], four["n_linked"], four["n_valid"]) == (3, 0, 0)
    for r in got:
        json.loads(r["json"])
    assert run(spark, []) == []


def test_same_identifier_in_other_conversations_and_repeats(spark):
    rows = [(c, 0, "assistant", call(("a", "fetch", {"url": f"u{c}"}))) for c in range(5)] + [(c, 1, "tool", result("a", str(c))) for c in range(4)] + [(0, 2, "tool", result("a", "late"))]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert {(r["conv_id"], r["n_linked"]) for r in got if r["role"] == "assistant"} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)}


def test_white_space_before_json(spark):
    got = run(spark, [(1, 0, "assistant", " \n\t" + call(("a", "fetch", {"url": "u"}))), (1, 1, "tool", "\r\n " + result("a"))])
    assert [(r["n_linked"], r["linked"]) for r in got] == [(1, False), (0, True)]


def test_a_long_chain(spark):
    """A thousand calls, each on the result of the one before, and a call on three of them."""
    rows = [(1, 2 * i, "assistant", call((f"c{i}", "fetch", {"url": f"$call:c{i - 1}" if i else "u"}))) for i in range(1000)]
    rows += [(1, 2 * i + 1, "tool", result(f"c{i}")) for i in range(1000)]
    rows += [(1, 5, "assistant", call(("join", "search", {"query": "x", "more": ["$call:c999", "$call:c3", "$call:c0"]})))]
    got = {(r["turn"], r["role"]): r for r in run(spark, rows)}
    assert all(got[2 * i, "assistant"]["level"] == 2 * i and got[2 * i, "assistant"]["at"] == 2 * i for i in range(1000))
    assert (got[5, "assistant"]["level"], got[5, "assistant"]["at"]) == (2000, 1999)


def fits(name, arguments):
    kinds = {"string": str, "integer": int, "number": (int, float), "object": dict}
    given, schema = json.loads(arguments), TOOLS.get(name)
    return schema is not None and all(k in schema and isinstance(v, kinds[schema[k][0]]) for k, v in given.items()) and all(k in given for k, (_, needed) in schema.items() if needed)


def test_thousands_of_calls_against_a_plain_version(spark):
    """Random conversations with chains, forks, cycles, missing results and references, repeated identifiers."""
    rng, rows = random.Random(6), []
    for c in range(150):
        ids, turn = [f"i{k}" for k in range(rng.randint(1, 25))], 0
        for i in ids:
            refs = rng.sample(ids + ["gone"], min(len(ids), rng.choice([0, 1, 1, 1, 2, 3]))) if rng.random() < 0.15 else rng.sample(ids[: ids.index(i)], min(ids.index(i), rng.choice([0, 1, 1, 2])))
            name = rng.choice([*TOOLS, "unknown"])
            arguments = {p: {"string": "s", "integer": 3, "number": 1.5, "object": {"a": 1}}[rng.choice([kind] * 5 + ["string"])] for p, (kind, needed) in TOOLS.get(name, {}).items() if needed or rng.random() < 0.3}
            if refs:
                arguments[next(iter(arguments), "x")] = [f"$call:{r}" for r in refs]
            rows.append((c, turn, "assistant", call((i, name, json.dumps(arguments)))))
            turn += rng.randint(1, 3)
            if rng.random() < 0.8:
                rows.append((c, turn + rng.randint(0, 5), "tool", result(i)))
                turn += 1
        rows.append((c, turn, "assistant", call((ids[0], "fetch", '{"url":"again"}'))))
        rows.append((c, turn, "user", "thanks"))
    calls, results = {}, {}
    for c, turn, role, text in rows:
        if role == "assistant":
            for x in json.loads(text)["tool_calls"]:
                k = (c, x["id"])
                if k not in calls or turn < calls[k][0]:
                    calls[k] = (turn, x["name"], x["arguments"], [r.split('"')[0] for r in x["arguments"].split('"$call:')[1:]])
        elif role == "tool":
            k = (c, json.loads(text)["tool_call_id"])
            results[k] = min(results.get(k, turn), turn)
    known = {}
    while True:
        fresh = {}
        for k, (turn, _, _, refs) in calls.items():
            ends = {(k[0], r) for r in refs}
            if k not in known and ends <= set(known):
                fresh[k] = (1 + max((known[e][0] for e in ends), default=-1), max([turn, *(known[e][1] for e in ends), *(results[e] for e in ends if e in results)]))
        if not fresh:
            break
        known |= fresh
    want = []
    for c, turn, role, text in rows:
        if role == "assistant":
            x = json.loads(text)["tool_calls"][0]
            k = (c, x["id"])
            level, at = known.get(k, (None, calls[k][0]))
            want.append((c, turn, role, max(turn, at), None if level is None else 2 * level, 1, int(k in results), int(fits(calls[k][1], calls[k][2])), False))
        elif role == "tool":
            k = (c, json.loads(text)["tool_call_id"])
            level, at = known.get(k, (None, calls[k][0]))
            want.append((c, turn, role, max(turn, at), None if level is None else 2 * level + 1, 0, 0, 0, True))
        else:
            want.append((c, turn, role, turn, 0, 0, 0, 0, False))
    assert len(known) < len(calls) and max(level for level, _ in known.values()) > 4
    got = [tuple(r[f] for f in ("conv_id", "turn", "role", "at", "level", "n_calls", "n_linked", "n_valid", "linked")) for r in run(spark, rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
