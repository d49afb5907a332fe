"""Histories with tool calls: transcripts, and the turns that the Agent or one user sees.

A history has a row per entry: trial, seq (not negative), kind (message, tool_call, tool_result),
speaker, content, name, arguments, result, error, has_tool_calls. A tool's row belongs to the message before
it. What is carried along a history goes by chunks of it (ordered.running), and texts are joined chunk by
chunk first, so a very long conversation is shared out among tasks; only its finished text is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed
from tripfold.operators.ordered import CHUNK_ROWS, Running, chunk_of, running

AGENT = fixed.AGENT


def joined(lines: DataFrame, keys: list[str], order: list[str], line: str, chunk: Column, by: str = "\n") -> DataFrame:
    """keys and text: each group's lines in order, joined within chunks (see running) and then the chunks."""
    told = lambda cols, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols, x))), lambda r: r[x]), by).alias(x)
    parts = lines.withColumn("_chunk", chunk).groupBy(*keys, "_chunk").agg(told(order, line))
    return parts.groupBy(*keys).agg(told(["_chunk"], line)).withColumnRenamed(line, "text")


def owned(history: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """history with _owner, the message before a tool's row (seq, speaker, has_tool_calls; null for messages and
    for tools' rows before any message), and _next, the kind of the entry that follows."""
    me = F.when(F.col("kind") == "message", F.struct("seq", "speaker", F.coalesce("has_tool_calls", F.lit(False)).alias("has_tool_calls")))
    out = running(history, ["trial"], ["seq"], [Running("_owner", "last", me), Running("_next", "next", F.col("kind"))], chunk_of("seq", rows))
    return out.withColumn("_owner", F.when(F.col("kind") != "message", F.col("_owner")))


def transcript_with_tools(history: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """C17: trial and text: a line for each message; the Agent's tools stand between its name and what it says, with
    a mark on errors. Tools' rows behind other messages are left out."""
    h = owned(history, rows)
    said = F.coalesce("content", F.lit(""))
    agent, tools = F.col("speaker") == AGENT, F.coalesce(F.col("_next").isin("tool_call", "tool_result"), F.lit(False))
    line = lambda part, x: F.struct(F.lit(part).alias("part"), x.alias("line"))
    plain = F.when(agent & (said == ""), F.concat("speaker", F.lit(":"))).otherwise(F.concat("speaker", F.lit(": "), said))
    both = F.filter(F.array(line(0, F.lit(f"{AGENT}:")), line(2, said)), lambda x: (x["part"] == 0) | (x["line"] != ""))
    messages = h.where("kind = 'message'").select("trial", F.col("seq").alias("_at"), "seq", F.explode(F.when(agent & tools, both).otherwise(F.array(line(0, plain)))).alias("_l"))
    call = F.concat(F.lit("tool_call: "), "name", F.lit("("), "arguments", F.lit(")"))
    result = F.concat(F.lit("tool_result:"), F.when(F.coalesce("error", F.lit(False)), " [ERROR]").otherwise(""), F.lit(" "), "result")
    of_tools = h.where(F.col("_owner.speaker") == AGENT).select("trial", F.col("_owner.seq").alias("_at"), "seq", line(1, F.when(F.col("kind") == "tool_call", call).otherwise(result)).alias("_l"))
    lines = messages.unionByName(of_tools).select("trial", "_at", "_l.part", "seq", "_l.line")
    return joined(lines, ["trial"], ["_at", "part", "seq"], "line", chunk_of("_at", rows))


def _merged(messages: DataFrame, mine: Column, rows: int) -> DataFrame:
    """One side's messages, each a turn of its own, and the others' between them as one turn each."""
    m = messages.withColumn("_mine", mine)
    m = running(m, ["trial"], ["seq"], [Running("_before", "prev", F.col("_mine"))], chunk_of("seq", rows))
    new = F.when(F.col("_mine") | F.coalesce("_before", F.lit(True)), 1).otherwise(0)
    m = running(m, ["trial"], ["seq"], [Running("_turn", "sum_upto", new)], chunk_of("seq", rows))
    others = m.where("not _mine").withColumn("line", F.concat("speaker", F.lit(": "), "content"))
    first = others.groupBy("trial", "_turn").agg(F.min("seq").alias("seq"))
    told = joined(others, ["trial", "_turn"], ["seq"], "line", chunk_of("seq", rows)).join(first, ["trial", "_turn"])
    told = told.select("trial", "seq", F.lit(0).alias("part"), F.lit("user").alias("kind"), F.col("text").alias("content"))
    return m.where("_mine").select("trial", "seq", F.lit(0).alias("part"), F.lit("assistant").alias("kind"), F.coalesce("content", F.lit("")).alias("content")).unionByName(told)


def _alternating(turns: DataFrame, rows: int) -> DataFrame:
    """A placeholder before an assistant's turn that opens the trial, or that follows another assistant's."""
    seen = running(turns, ["trial"], ["seq", "part"], [Running("_before", "prev", F.col("kind"))], chunk_of("seq", rows))
    what = F.when(F.col("_before").isNull(), fixed.PLACEHOLDER_START).when(F.col("_before") == "assistant", fixed.PLACEHOLDER_SILENT)
    extra = seen.where("kind = 'assistant'").select("trial", "seq", F.lit(-1).alias("part"), F.lit("user").alias("kind"), what.alias("content")).where("content is not null")
    return turns.unionByName(extra, allowMissingColumns=True)


def agent_turns(history: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """C20: the Agent's view. trial, seq, part, kind (user, assistant, tool), content, name, calls (an assistant's
    number of tool calls) and call (the one that a tool's row answers: the latest before it, 0 for none).

    Users' messages between two of the Agent's are one turn. Tools' rows count behind a message of the Agent's
    that has tool calls. A placeholder comes in where two assistants would meet.
    """
    h = owned(history, rows)
    turns = _merged(h.where("kind = 'message'").select("trial", "seq", "speaker", "content"), F.col("speaker") == AGENT, rows)
    tools = h.where((F.col("_owner.speaker") == AGENT) & F.col("_owner.has_tool_calls")).withColumn("_at", F.col("_owner.seq"))
    tools = running(tools, ["trial", "_at"], ["seq"], [Running("call", "sum_upto", F.when(F.col("kind") == "tool_call", 1).otherwise(0))], chunk_of("seq", rows))
    calls = tools.where("kind = 'tool_call'").groupBy(F.col("trial").alias("_t"), F.col("_at").alias("_s")).agg(F.count("*").alias("calls"))
    told = turns.join(calls, F.col("trial").eqNullSafe(F.col("_t")) & (F.col("seq") == F.col("_s")) & (F.col("kind") == "assistant"), "left").drop("_t", "_s")
    none = F.lit(None)
    own = told.select("trial", "seq", "part", "kind", "content", none.cast("string").alias("name"), F.when(F.col("kind") == "assistant", F.coalesce("calls", F.lit(0))).alias("calls"), none.cast("long").alias("call"))
    answers = tools.where("kind = 'tool_result'").select(
        "trial", F.col("_at").alias("seq"), (F.col("seq") - F.col("_at")).cast("int").alias("part"), F.lit("tool").alias("kind"), F.coalesce("result", F.lit("")).alias("content"),
        F.coalesce("name", F.lit("unknown")).alias("name"), none.cast("long").alias("calls"), F.col("call").cast("long").alias("call"),
    )
    return _alternating(own.unionByName(answers), rows)


def user_turns(history: DataFrame, speaker: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """One user's view. trial, seq, part, kind and content: their own messages are the assistant's, all others
    between them one user's turn. Tools' rows and messages with tool calls aren't seen."""
    seen = history.where((F.col("kind") == "message") & ~F.coalesce("has_tool_calls", F.lit(False)))
    seen = seen.select("trial", "seq", "speaker", F.coalesce("content", F.lit("")).alias("content"))
    return _alternating(_merged(seen, F.col("speaker") == speaker, rows), rows)


def without_reasoning(history: DataFrame) -> DataFrame:
    """The history as it is saved, without the Agent's reasoning."""
    return history.drop("reasoning_content")


def build_prompts(rows: DataFrame, template: str, fields: list[str], prompt: str = "prompt") -> DataFrame:
    """Rows with a prompt: the template, in which {name} stands for the column name. Values aren't searched
    for names again; a null is an empty text."""
    pieces, rest = [], template
    while rest:
        at = {f: rest.find("{" + f + "}") for f in fields}
        name = min((f for f in fields if at[f] >= 0), key=at.__getitem__, default=None)
        if name is None:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[: at[name]]), F.coalesce(F.col(name).cast("string"), F.lit(""))]
        rest = rest[at[name] + len(name) + 2 :]
    return rows.withColumn(prompt, F.concat(*pieces) if pieces else F.lit(""))


def validated(tasks: DataFrame) -> DataFrame:
    """tasks(query, user_preferences VARIANT, initial_messages ARRAY, …) with valid and the first reason
    against: no query, no preferences, no opening messages."""
    prefs = F.col("user_preferences")
    filled = F.coalesce(F.size(F.try_variant_get(prefs, "$", "map<string,variant>")) > 0, F.size(F.try_variant_get(prefs, "$", "array<variant>")) > 0, F.lit(False))
    reason = F.when(F.col("query").isNull(), "query").when(~filled, "user_preferences").when(~F.coalesce(F.size("initial_messages") > 0, F.lit(False)), "initial_messages")
    return tasks.withColumn("error", reason).withColumn("valid", reason.isNull())
