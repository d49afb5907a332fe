"""Turns and transcripts against histories that are walked entry by entry."""

import random

import pytest

from tripfold.functions import fixed
from tripfold.operators import turns as T

KIND = "trial long, seq long, kind string, speaker string, content string, name string, arguments string, result string, error boolean, has_tool_calls boolean"


def history(rng, trial, n):
    rows = []
    for seq in range(n):
        kind = rng.choice(["message", "message", "tool_call", "tool_result"])
        if kind == "message":
            speaker = rng.choice(["Agent", "Agent", "U1", "U2"])
            rows.append((trial, seq, kind, speaker, rng.choice(["hi", "", f"m{seq}", "two\nlines"]), None, None, None, None, rng.choice([True, False, None]) if speaker == "Agent" else None))
        elif kind == "tool_call":
            rows.append((trial, seq, kind, None, None, f"t{seq}", "{}", None, None, None))
        else:
            rows.append((trial, seq, kind, None, None, rng.choice([None, f"t{seq}"]), None, rng.choice(["ok", ""]), rng.choice([True, False, None]), None))
    return rows


def walked_transcript(rows):
    lines, i = [], 0
    while i < len(rows):
        _, _, kind, speaker, content, *_ = rows[i]
        i += 1
        if kind != "message":
            continue
        tools = []
        while speaker == "Agent" and i < len(rows) and rows[i][2] != "message":
            r = rows[i]
            tools.append(f"tool_call: {r[5]}({r[6]})" if r[2] == "tool_call" else f"tool_result:{' [ERROR]' if r[8] else ''} {r[7]}")
            i += 1
        if tools:
            lines += ["Agent:", *tools, *([content] if content else [])]
        else:
            lines.append(f"{speaker}: {content}" if content or speaker != "Agent" else "Agent:")
    return "\n".join(lines)


def repaired(turns):
    out = []
    for t in turns:
        if t[0] == "assistant" and (not out or out[-1][0] == "assistant"):
            out.append(("user", fixed.PLACEHOLDER_SILENT if out else fixed.PLACEHOLDER_START, None, None, None))
        out.append(t)
    return out


def walked_agent(rows):
    out, held, i = [], [], 0
    while i < len(rows):
        r = rows[i]
        i += 1
        if r[2] != "message":
            continue
        if r[3] != "Agent":
            held.append(f"{r[3]}: {r[4]}")
            continue
        if held:
            out.append(("user", "\n".join(held), None, None, None))
            held = []
        calls, answers = 0, []
        while r[9] and i < len(rows) and rows[i][2] != "message":
            if rows[i][2] == "tool_call":
                calls += 1
            else:
                answers.append(("tool", rows[i][7], rows[i][5] or "unknown", None, calls))
            i += 1
        out += [("assistant", r[4], None, calls, None), *answers]
    return repaired(out + ([("user", "\n".join(held), None, None, None)] if held else []))


def walked_user(rows, me):
    out, held = [], []
    for r in rows:
        if r[2] != "message" or r[9]:
            continue
        if r[3] == me:
            out += [("user", "\n".join(held), None, None, None)] if held else []
            out.append(("assistant", r[4], None, None, None))
            held = []
        else:
            held.append(f"{r[3]}: {r[4]}")
    return repaired(out + ([("user", "\n".join(held), None, None, None)] if held else []))


@pytest.fixture(scope="module")
def trials(spark):
    rng = random.Random(4)
    rows = {k: history(rng, k, rng.randint(1, 25)) for k in range(120)}
    return rows, spark.createDataFrame([r for h in rows.values() for r in h], KIND).repartition(5).cache()


def listed(df, columns):
    out: dict = {}
    for r in df.orderBy("trial", "seq", "part").collect():
        out.setdefault(r["trial"], []).append(tuple(r[c] if c in columns else None for c in ("kind", "content", "name", "calls", "call")))
    return out


@pytest.mark.parametrize("rows", [65_536, 3])
def test_transcripts_with_tools(trials, rows):
    given, df = trials
    got = {r["trial"]: r["text"] for r in T.transcript_with_tools(df, rows).collect()}
    want = {k: t for k, h in given.items() if (t := walked_transcript(h)) or any(r[2] == "message" for r in h)}
    assert got == want


@pytest.mark.parametrize("rows", [65_536, 3])
def test_the_agents_turns(trials, rows):
    given, df = trials
    got = listed(T.agent_turns(df, rows), ("kind", "content", "name", "calls", "call"))
    assert got == {k: t for k, h in given.items() if (t := walked_agent(h))}


@pytest.mark.parametrize("rows", [65_536, 3])
def test_a_users_turns(trials, rows):
    given, df = trials
    got = listed(T.user_turns(df, "U1", rows), ("kind", "content"))
    assert got == {k: t for k, h in given.items() if (t := walked_user(h, "U1"))}


def test_a_long_conversation_is_shared_out(spark):
    n = 100_000
    df = spark.range(n).selectExpr("1L AS trial", "id AS seq", "if(id % 4 = 2, 'tool_call', if(id % 4 = 3, 'tool_result', 'message')) AS kind", "if(id % 4 = 0, 'U1', if(id % 4 = 1, 'Agent', null)) AS speaker",
                               "concat('m', id) AS content", "'t' AS name", "'{}' AS arguments", "'r' AS result", "false AS error", "id % 4 = 1 AS has_tool_calls")
    text = T.transcript_with_tools(df, 1_000).first()["text"]
    assert text.count("\n") == n // 4 * 5 - 1 and text.startswith("U1: m0\nAgent:\ntool_call: t({})\ntool_result: r\nm1\nU1: m4") and text.endswith("m99997")
    assert T.agent_turns(df, 1_000).count() == n // 4 * 3


def test_prompts_and_validation(spark):
    df = spark.createDataFrame([("x{b}", None, 3)], "a string, b string, c int")
    assert T.build_prompts(df, "{c}: {a}/{b}/{a} {d}", ["a", "b", "c"]).first()["prompt"] == "3: x{b}//x{b} {d}"
    assert T.build_prompts(df, "", ["a"]).first()["prompt"] == ""
    rows = [(None, '{"u":1}', ["m"]), ("q", "{}", ["m"]), ("q", None, ["m"]), ("q", '{"u":{}}', []), ("q", '{"u":{}}', None), ("q", '{"u":{}}', ["m"]), ("", '[1]', ["m"])]
    tasks = spark.createDataFrame(rows, "query string, p string, initial_messages array<string>").selectExpr("query", "try_parse_json(p) AS user_preferences", "initial_messages")
    assert [r["error"] for r in T.validated(tasks).collect()] == ["query", "user_preferences", "user_preferences", "initial_messages", "initial_messages", None, None]
    assert T.without_reasoning(spark.createDataFrame([(1, "r")], "seq int, reasoning_content string")).columns == ["seq"]
