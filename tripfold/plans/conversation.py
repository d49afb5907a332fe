"""Queries of the conversation family. The given texts have no mentions, markers or JSON, so those are put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripfold.functions import fixed, text
from tripfold.operators import conversation as C
from tripfold.operators import scoring as S
from tripfold.operators import turns as T
from tripfold.plans.adapters import HISTORY, history, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _his(spark, sf_dir):
    return history(spark, sf_dir)


@query("SELECT conv_id AS trial, count(*) AS entries, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS agent, sum(length(text))::BIGINT AS chars FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def q_hist(spark, sf_dir):
    """Outward entries."""
    h = _his(spark, sf_dir).where("speaker <> 'User2'")
    return h.groupBy("trial").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("speaker") == "Agent", 1).otherwise(0)).alias("agent"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {HISTORY} SELECT trial, max(seq) AS seq, arg_max(speaker, seq) AS speaker, arg_max(content, seq) AS content FROM his WHERE speaker <> 'User2' GROUP BY trial")
def q_lastmsg(spark, sf_dir):
    return C.last_outward(_his(spark, sf_dir), F.col("speaker") != "User2")


@query(f"WITH {HISTORY} SELECT trial, seq, speaker FROM his WHERE seq < (SELECT max(seq) FROM his h WHERE h.trial = his.trial AND speaker <> 'User1')")
def q_beforelast(spark, sf_dir):
    return C.before_last(_his(spark, sf_dir), F.col("speaker") != "User1").select("trial", "seq", "speaker")


@query(f"WITH {HISTORY}, g AS (SELECT trial, max(CASE WHEN speaker = 'User1' THEN seq END) AS a, max(CASE WHEN speaker <> 'User1' THEN seq END) AS b FROM his GROUP BY trial) SELECT trial, a IS NULL OR coalesce(b > a, false) AS unseen FROM g")
def q_unseen(spark, sf_dir):
    return C.unseen(_his(spark, sf_dir), "User1")


@query(f"WITH {HISTORY} SELECT trial, max(seq) AS seq, arg_max(concat('{{\"v\":', CAST(seq AS VARCHAR), '}}'), seq) AS value FROM his WHERE speaker = 'Agent' AND seq % 3 > 0 GROUP BY trial")
def q_maxby(spark, sf_dir):
    """The latest object in an Agent's message; every third has none that parses."""
    shown = F.concat(F.lit("Plan: "), F.when(F.col("seq") % 3 > 0, F.concat(F.lit('{"v":'), F.col("seq").cast("string"), F.lit("} so."))).otherwise('{"v": '))
    h = _his(spark, sf_dir).withColumn("content", shown)
    found = text.embedded_json("content", "v")
    return C.latest(h, (F.col("speaker") == "Agent") & found.isNotNull(), found)


_ASKED = """, m AS (SELECT *, CASE WHEN speaker = 'Agent' THEN CASE seq % 4 WHEN 0 THEN 'User2' WHEN 1 THEN 'User1' WHEN 2 THEN 'User1' END END AS who FROM his)"""


def _asking(spark, sf_dir):
    m = F.col("seq") % 4
    tail = F.when(F.col("speaker") != "Agent", "").when(m == 0, " @User1 then @User2, ok").when(m == 1, " @User1").when(m == 2, " @User1请回答 @User19").otherwise(" @User1x")
    return _his(spark, sf_dir).withColumn("content", F.concat("content", tail))


@query(f"WITH {HISTORY}{_ASKED} SELECT trial, seq, who FROM m WHERE speaker = 'Agent'")
def q_mention(spark, sf_dir):
    """The rightmost name."""
    return _asking(spark, sf_dir).where("speaker = 'Agent'").select("trial", "seq", text.mention("content", ["User1", "User2"]).alias("who"))


@query(f"WITH {HISTORY}{_ASKED}, p AS (SELECT *, lag(who) OVER (PARTITION BY trial ORDER BY seq) AS w FROM m) SELECT trial, seq, coalesce(w = speaker, false) AS solicited FROM p WHERE speaker <> 'Agent'")
def q_lagrole(spark, sf_dir):
    return C.solicited(_asking(spark, sf_dir), text.mention("content", ["User1", "User2"])).select("trial", "seq", "solicited")


_SIDES = f"""WITH {HISTORY}, s AS (SELECT trial, seq, content, CASE WHEN seq % 3 = 1 THEN 'Agent' ELSE 'users' END AS side FROM his),
c AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY trial ORDER BY seq) = side THEN 0 ELSE 1 END AS new FROM s),
t AS (SELECT *, sum(new) OVER (PARTITION BY trial ORDER BY seq ROWS UNBOUNDED PRECEDING) AS turn FROM c)"""


@query(_SIDES + " SELECT trial, CAST(turn AS BIGINT) AS turn, min(side) AS side, min(seq) AS first_seq, count(*) AS n, string_agg(content, chr(10) ORDER BY seq) AS content FROM t GROUP BY trial, turn")
def q_merge(spark, sf_dir):
    return C.merged_turns(_his(spark, sf_dir), F.when(F.col("seq") % 3 == 1, "Agent").otherwise("users"))


_FIRST, _BETWEEN = fixed.PLACEHOLDER_START, fixed.PLACEHOLDER_SILENT


@query(f"""WITH {HISTORY}, k AS (SELECT trial, seq, content, CASE WHEN seq % 3 = 1 THEN 'user' ELSE 'assistant' END AS kind FROM his),
b AS (SELECT *, lag(kind) OVER (PARTITION BY trial ORDER BY seq) AS p FROM k)
SELECT trial, seq, 0 AS part, 'user' AS kind, CASE WHEN p IS NULL THEN '{_FIRST}' ELSE '{_BETWEEN}' END AS content FROM b WHERE kind = 'assistant' AND (p IS NULL OR p = 'assistant')
UNION ALL SELECT trial, seq, 1, kind, content FROM b""")
def q_altern(spark, sf_dir):
    turns = _his(spark, sf_dir).withColumn("kind", F.when(F.col("seq") % 3 == 1, "user").otherwise("assistant"))
    return C.alternated(turns, _FIRST, _BETWEEN)


@query(f"WITH {HISTORY} SELECT trial, string_agg(concat('[', speaker, ']: ', content), chr(10) ORDER BY seq) AS transcript FROM his WHERE speaker <> 'User2' GROUP BY trial")
def q_transcript(spark, sf_dir):
    """Labelled lines without the tool's side."""
    return C.transcript(_his(spark, sf_dir), F.concat(F.lit("["), F.col("speaker"), F.lit("]: "), F.col("content")), F.col("speaker") != "User2")


_CUT = 40


@query(f"WITH {HISTORY} SELECT trial, string_agg(CASE WHEN speaker = 'User2' AND length(content) > {_CUT} THEN concat(left(content, {_CUT}), '{fixed.JUDGE_CUT_MARK}') ELSE content END, chr(10) ORDER BY seq) AS transcript FROM his GROUP BY trial")
def q_trunc(spark, sf_dir):
    """One side's lines are cut at a given length."""
    line = F.when(F.col("speaker") == "User2", text.cut_text("content", _CUT, fixed.JUDGE_CUT_MARK)).otherwise(F.col("content"))
    return C.transcript(_his(spark, sf_dir), line)


@query(f"WITH {HISTORY} SELECT trial, seq, CASE WHEN seq % 3 = 0 THEN rtrim(content) WHEN seq % 3 = 1 THEN ' [pass] ' ELSE content END AS said, seq % 3 = 1 AS passed FROM his")
def q_pass(spark, sf_dir):
    """C11: trailing pass tokens go, a message of nothing else stays."""
    m = F.col("seq") % 3
    said = F.when(m == 0, F.concat("content", F.lit(" [PASS] [pass]\n"))).when(m == 1, " [pass] ").otherwise(F.col("content"))
    return _his(spark, sf_dir).select("trial", "seq", text.strip_pass(said).alias("said"), text.is_pass(said).alias("passed"))


_EDITS = (
    (" [avg_budget : 1800]", "avg_budget", "1800", "ok"),
    (' [transport.must : ["x"]', "transport.must", '["x"]', "repaired"),
    (" [transport.must : 高铁]", "transport.must", '"高铁"', "bare"),
    (" [avg_budget : 1] 再见", None, None, None),
    (" [a.b : []", "a.b", "[]", "repaired"),
)
_KNOWN = ("global_constraints.avg_budget", "global_constraints.transport.must")


def _edited(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(e[0]) for e in _EDITS]), (F.col("seq") % len(_EDITS) + 1).cast("int"))
    h = _his(spark, sf_dir).withColumn("content", F.concat("content", tail))
    return h.withColumn("_m", text.marker("content")).select("trial", "seq", "speaker", "_m.path", "_m.value", "_m.status")


def _sql_text(x) -> str:
    return "NULL" if x is None else "'" + x + "'"


_MARKED = f"WITH {HISTORY}, e(k, path, value, status) AS (VALUES " + ", ".join(f"({i}, {_sql_text(p)}, {_sql_text(v)}, {_sql_text(s)})" for i, (_, p, v, s) in enumerate(_EDITS)) + "), m AS (SELECT trial, seq, speaker, path, value, status FROM his JOIN e ON seq % 5 = k)"


@query(_MARKED + " SELECT trial, seq, path, value, status FROM m")
def q_marker(spark, sf_dir):
    return _edited(spark, sf_dir).select("trial", "seq", "path", "value", "status")


@query(_MARKED + f""", r AS (SELECT *, CASE WHEN path IN {('avg_budget', 'transport.must')} THEN concat('global_constraints.', path) END AS real_path FROM m WHERE path IS NOT NULL)
SELECT trial, seq, real_path, real_path IS NOT NULL AND sum(CASE WHEN real_path IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trial, speaker ORDER BY seq ROWS UNBOUNDED PRECEDING) <= 2 AS applied FROM r""")
def q_lww(spark, sf_dir):
    """C15."""
    return C.two_edits(_edited(spark, sf_dir).where("path is not null"), list(_KNOWN)).select("trial", "seq", "real_path", "applied")


@query(f"WITH {HISTORY} SELECT trial, seq, CASE seq % 3 WHEN 0 THEN 'global_constraints.avg_budget' WHEN 1 THEN 'transport.must' ELSE 'intensity.max_poi_per_day' END AS path FROM his")
def q_path(spark, sf_dir):
    """C13."""
    m = F.col("seq") % 3
    bad = F.when(m == 0, "global_constraints_constraints.avg_budget").when(m == 1, "transport.transport.must").otherwise("intensity.max_poi_per_day_x.max_poi_per_day")
    return _his(spark, sf_dir).select("trial", "seq", text.fix_path(bad).alias("path"))


@query(f"WITH {HISTORY} SELECT trial, max(CASE WHEN speaker = 'User1' THEN 1 ELSE 0 END) = 1 AS valid, CASE WHEN max(CASE WHEN speaker = 'User1' THEN 1 ELSE 0 END) = 0 THEN 'initial_messages' END AS error FROM his GROUP BY trial")
def q_validtasks(spark, sf_dir):
    """Trials without an opening message are refused, with the reason."""
    g = _his(spark, sf_dir).groupBy("trial").agg(F.bool_or(F.col("speaker") == "User1").alias("valid"))
    return g.withColumn("error", F.when(~F.col("valid"), "initial_messages"))


_PLAN = """p AS (SELECT trial, seq, speaker, seq % 4 AS m FROM his)"""


@query(f"WITH {HISTORY}, {_PLAN} SELECT trial, max(seq) AS seq, arg_max(concat('{{\"days\":[{{\"city_segments\":[{{\"n\":', CAST(seq AS VARCHAR), '}}]}}]}}'), seq) AS plan FROM p WHERE speaker = 'Agent' AND m < 2 GROUP BY trial")
def q_finalplan(spark, sf_dir):
    """The latest plan that parses and has the shape of one; a fence or none, no segments, no JSON."""
    n, m = F.col("seq").cast("string"), F.col("seq") % 4
    body = F.concat(F.lit('{"days":[{"city_segments":['), F.when(m == 2, "").otherwise(F.concat(F.lit('{"n":'), n, F.lit("}"))), F.lit("]}]"), F.when(m == 3, "").otherwise("}"))
    said = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nok?"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" ok?")))
    h = _his(spark, sf_dir).withColumn("content", said).withColumn("_plan", text.embedded_json("content", "days"))
    return C.latest(h, (F.col("speaker") == "Agent") & S.is_plan(F.try_parse_json("_plan")), F.col("_plan")).withColumnRenamed("value", "plan")


@query(f"WITH {HISTORY} SELECT trial, seq, seq % 4 = 0 AS ok FROM his")
def q_prefs(spark, sf_dir):
    """Tables of every user's sections; a user without any, a value that is no object, an empty table."""
    m = F.col("seq") % 4
    said = (
        F.when(m == 0, '{"U1":{"global_constraints":{}},"U2":{"city_specific_preferences":{"X":{}},"more":1}}')
        .when(m == 1, '{"U1":{"global_constraints":{}},"U2":{"more":1}}').when(m == 2, '{"U1":{"global_constraints":{}},"U2":3}').otherwise("{}")
    )
    return _his(spark, sf_dir).select("trial", "seq", S.is_preference_table(F.try_parse_json(said)).alias("ok"))


# --- histories with tool calls: up to two calls or results behind a message; the second result has no call of its own
_SPEAKER = "CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'User1' ELSE 'User2' END"
_TOOLS = "CASE WHEN role = 'assistant' THEN turn % 3 WHEN turn % 5 = 0 THEN 1 ELSE 0 END"
_TOOLED = f"""msg AS (SELECT conv_id AS trial, turn * 8 AS seq, {_SPEAKER} AS speaker, CASE WHEN turn % 7 = 3 THEN '' ELSE text END AS content, {_TOOLS} AS k, CASE WHEN role = 'assistant' THEN (conv_id + turn) % 4 <> 0 END AS has FROM conversations),
tool AS (SELECT trial, seq AS own, speaker, has, seq + 1 AS seq, 'tool_call' AS kind, 0 AS j FROM msg WHERE k > 0 UNION ALL SELECT trial, seq, speaker, has, seq + 2 + 2 * j, 'tool_result', j FROM msg, range(2) r(j) WHERE j < k)"""


def _tooled(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id AS trial", "turn * 8 AS seq", f"{_SPEAKER} AS speaker", "CASE WHEN turn % 7 = 3 THEN '' ELSE text END AS content", f"int({_TOOLS}) AS k", "CASE WHEN role = 'assistant' THEN (conv_id + turn) % 4 <> 0 END AS has_tool_calls")
    nothing = ["CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS arguments", "CAST(NULL AS STRING) AS result", "CAST(NULL AS BOOLEAN) AS error"]
    messages = c.selectExpr("trial", "seq", "'message' AS kind", "speaker", "content", *nothing, "has_tool_calls")
    each = c.where("k > 0").selectExpr("trial", "seq", "explode(flatten(transform(sequence(0, k - 1), j -> filter(array(struct('tool_call' AS kind, j, 1 AS step), struct('tool_result' AS kind, j, 2 + 2 * j AS step)), x -> x.kind = 'tool_result' OR j = 0)))) AS t")
    tools = each.selectExpr(
        "trial", "seq + t.step AS seq", "t.kind", "CAST(NULL AS STRING) AS speaker", "CAST(NULL AS STRING) AS content", "concat('t', t.j) AS name", "CASE t.kind WHEN 'tool_call' THEN concat('{\"q\":', seq, '}') END AS arguments",
        "CASE t.kind WHEN 'tool_result' THEN concat('r', seq) END AS result", "CASE t.kind WHEN 'tool_result' THEN (seq + t.j) % 2 = 1 END AS error", "CAST(NULL AS BOOLEAN) AS has_tool_calls",
    )
    return messages.unionByName(tools)


@query(f"""WITH {_TOOLED}, l AS (SELECT trial, seq AS own, 0 AS part, seq, CASE WHEN speaker = 'Agent' AND (k > 0 OR content = '') THEN 'Agent:' ELSE concat(speaker, ': ', content) END AS line FROM msg
  UNION ALL SELECT trial, seq, 2, seq, content FROM msg WHERE speaker = 'Agent' AND k > 0 AND content <> ''
  UNION ALL SELECT trial, own, 1, seq, CASE WHEN kind = 'tool_call' THEN concat('tool_call: t0({{"q":', CAST(own AS VARCHAR), '}})') ELSE concat('tool_result:', CASE WHEN (own + j) % 2 = 1 THEN ' [ERROR]' ELSE '' END, ' r', CAST(own AS VARCHAR)) END FROM tool WHERE speaker = 'Agent')
SELECT trial, string_agg(line, chr(10) ORDER BY own, part, seq) AS text FROM l GROUP BY trial""")
def q_tooltext(spark, sf_dir):
    """C17: tools inlined behind the Agent's name, errors marked; tools behind a user's message are left out."""
    return T.transcript_with_tools(_tooled(spark, sf_dir))


_MERGED = """, m AS (SELECT *, {mine} AS mine FROM msg WHERE {seen}), b AS (SELECT *, lag(mine) OVER (PARTITION BY trial ORDER BY seq) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN mine OR coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY seq ROWS UNBOUNDED PRECEDING) AS turn FROM b),
u AS (SELECT trial, seq, 0 AS part, 'assistant' AS kind, content FROM n WHERE mine UNION ALL SELECT trial, min(seq), 0, 'user', string_agg(concat(speaker, ': ', content), chr(10) ORDER BY seq) FROM n WHERE NOT mine GROUP BY trial, turn)"""


@query(f"""WITH {_TOOLED}{_MERGED.format(mine="speaker = 'Agent'", seen="true")}, x AS (SELECT u.trial, u.seq, part, u.kind, u.content, NULL AS name, CASE WHEN u.kind = 'assistant' THEN CASE WHEN k > 0 AND has THEN 1 ELSE 0 END END AS calls, NULL AS call FROM u JOIN msg ON msg.trial = u.trial AND msg.seq = u.seq
  UNION ALL SELECT trial, own, CAST(seq - own AS INT), 'tool', concat('r', CAST(own AS VARCHAR)), concat('t', CAST(j AS VARCHAR)), NULL, 1 FROM tool WHERE kind = 'tool_result' AND has),
w AS (SELECT *, lag(kind) OVER (PARTITION BY trial ORDER BY seq, part) AS was FROM x)
SELECT trial, seq, part, kind, content, name, calls, call FROM x UNION ALL SELECT trial, seq, -1, 'user', CASE WHEN was IS NULL THEN '{_FIRST}' ELSE '{_BETWEEN}' END, NULL, NULL, NULL FROM w WHERE kind = 'assistant' AND (was IS NULL OR was = 'assistant')""")
def q_agentturns(spark, sf_dir):
    """Results go with the latest call; two results of one call, messages whose tools don't count."""
    return T.agent_turns(_tooled(spark, sf_dir)).withColumn("calls", F.col("calls").cast("int")).withColumn("call", F.col("call").cast("int"))


@query(f"""WITH {_TOOLED}{_MERGED.format(mine="speaker = 'User1'", seen="NOT coalesce(has, false)")}, w AS (SELECT *, lag(kind) OVER (PARTITION BY trial ORDER BY seq, part) AS was FROM u)
SELECT trial, seq, part, kind, content FROM u UNION ALL SELECT trial, seq, -1, 'user', CASE WHEN was IS NULL THEN '{_FIRST}' ELSE '{_BETWEEN}' END FROM w WHERE kind = 'assistant' AND (was IS NULL OR was = 'assistant')""")
def q_userturns(spark, sf_dir):
    """Neither tools nor the Agent's steps between them are seen."""
    return T.user_turns(_tooled(spark, sf_dir), "User1")


@query("SELECT conv_id, turn, concat('Judge turn ', CAST(turn AS VARCHAR), ' of {role}:' , chr(10), coalesce(text, ''), ' (', role, ')') AS prompt FROM conversations")
def q_prompts(spark, sf_dir):
    """A template with names that aren't columns' and texts that may hold names."""
    rows = table(spark, sf_dir, "conversations").withColumn("who", F.col("role"))
    return T.build_prompts(rows, "Judge turn {turn} of {role}:\n{text} ({who})", ["turn", "text", "who"]).select("conv_id", "turn", "prompt")


@query("""SELECT o_orderkey AS task, o_orderkey % 5 > 1 AND o_orderkey % 7 > 1 AND o_orderkey % 3 > 0 AS valid,
  CASE WHEN o_orderkey % 5 <= 1 THEN 'query' WHEN o_orderkey % 7 <= 1 THEN 'user_preferences' WHEN o_orderkey % 3 = 0 THEN 'initial_messages' END AS error FROM orders""")
def q_taskcheck(spark, sf_dir):
    """The three reasons, the first that holds."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("task"), F.when(k % 5 > 1, "go").alias("query"), F.try_parse_json(F.when(k % 7 == 0, "{}").when(k % 7 > 1, '{"U0":{}}')).alias("user_preferences"),
        F.when(k % 3 == 1, F.array(F.lit("hi"))).when(k % 3 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("initial_messages"),
    )
    return T.validated(rows).select("task", "valid", "error")
