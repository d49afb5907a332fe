"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.session import tune


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark, sf_dir: str) -> DataFrame:
    """Events as activities: user, day, ix, hour, typ, place, start and end minute, cost, and ls.

    An end at or before the start is overnight. A day's list is in order of ls, then ix, which isn't that of
    the clock.
    """
    start = F.hour("ts") * 60 + F.minute("ts")
    kind = F.create_map(*[F.lit(x) for x in ("view", "attraction", "click", "food", "purchase", "hotel", "signup", "intracity_transport")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("usr"), F.to_date("ts").alias("d"), F.col("event_id").alias("ix"), F.hour("ts").alias("hr"),
        (F.col("event_id") % 13).cast("int").alias("ls"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("rest")).alias("typ"), start.alias("st"),
        ((start + F.floor("value").cast("int")) % 1440).alias("en"),
        F.concat(F.lit("L"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 20).cast("string")).alias("loc"), F.col("value").alias("cost"),
    )


ACTIVITIES = """
evt AS (SELECT user_id AS usr, CAST(ts AS DATE) AS d, event_id AS ix, hour(ts) AS hr, event_id % 13 AS ls,
  CASE event_type WHEN 'view' THEN 'attraction' WHEN 'click' THEN 'food' WHEN 'purchase' THEN 'hotel'
    WHEN 'signup' THEN 'intracity_transport' ELSE 'rest' END AS typ,
  CAST(hour(ts) * 60 + minute(ts) AS INT) AS st, CAST((hour(ts) * 60 + minute(ts) + CAST(floor(value) AS INT)) % 1440 AS INT) AS en,
  concat('L', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR)) AS loc, value AS cost
  FROM events)"""


def trials(spark, sf_dir: str) -> DataFrame:
    """Order lines as trials of tasks; an order without lines is a task without a trial."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("difficulty"), F.col("l_linenumber").alias("trial"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("score"), (F.col("l_returnflag") == "R").alias("failed"),
    )


TRIALS = """
trl AS (SELECT o_orderkey AS task, o_orderpriority AS difficulty, l_linenumber AS trial,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS score, l_returnflag = 'R' AS failed
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"""


def history(spark, sf_dir: str) -> DataFrame:
    """Conversations as histories: trial, seq, speaker and content."""
    role = F.when(F.col("role") == "assistant", "Agent").when(F.col("role") == "user", "User1").otherwise("User2")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trial"), F.col("turn").alias("seq"), role.alias("speaker"), F.col("text").alias("content"))


HISTORY = """
his AS (SELECT conv_id AS trial, turn AS seq, CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'User1' ELSE 'User2' END AS speaker,
  text AS content FROM conversations)"""


def calls(spark, sf_dir: str) -> DataFrame:
    """Events as tool calls: trial, seq, tool, arguments; early: the first half by id, which fills the cache."""
    e = table(spark, sf_dir, "events")
    half = ((e.agg(F.max("event_id")).first()[0] or 0) + 1) / 2
    return e.select(
        F.col("user_id").alias("trial"), F.col("ts"), F.col("event_id").alias("seq"), F.hour("ts").alias("hr"), F.to_date("ts").alias("d"),
        F.col("event_type").alias("tool"), F.col("props").alias("arguments"), (F.col("event_id") < half).alias("early"), F.col("value"),
    )


CALLS = """
cal AS (SELECT user_id AS trial, ts, event_id AS seq, hour(ts) AS hr, CAST(ts AS DATE) AS d, event_type AS tool, props AS arguments,
  event_id < (SELECT (max(event_id) + 1) / 2 FROM events) AS early, value FROM events)"""
