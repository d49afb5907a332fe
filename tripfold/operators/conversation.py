"""Conversation logs: last messages, unseen messages, turns, transcripts.

A history is a row per entry: trial, seq, speaker, content. Windows run within one trial, whose length
the run's settings bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.functions import fixed


def in_trial():
    return Window.partitionBy("trial")


def in_order():
    return in_trial().orderBy("seq")


def last_outward(history: DataFrame, outward: Column) -> DataFrame:
    """The last entry of each trial that satisfies outward."""
    kept = history.where(outward).groupBy("trial").agg(F.max_by(F.struct("seq", "speaker", "content"), "seq").alias("_m"))
    return kept.select("trial", "_m.*")


def before_last(history: DataFrame, message: Column) -> DataFrame:
    """The entries before each trial's last message; that one and what follows it go."""
    return history.withColumn("_last", F.max(F.when(message, F.col("seq"))).over(in_trial())).where("seq < _last").drop("_last")


def unseen(history: DataFrame, speaker: str) -> DataFrame:
    """For each trial whether others have spoken since the speaker last did; true if it never did."""
    mine = F.max(F.when(F.col("speaker") == speaker, F.col("seq")))
    theirs = F.max(F.when(F.col("speaker") != speaker, F.col("seq")))
    return history.groupBy("trial").agg(mine.alias("mine"), theirs.alias("theirs")).select("trial", (F.col("mine").isNull() | F.coalesce(F.col("theirs") > F.col("mine"), F.lit(False))).alias("unseen"))


def solicited(history: DataFrame, mentioned: Column) -> DataFrame:
    """C14: users' entries, and whether the entry before is the Agent's and mentions the speaker."""
    asked = F.lag(F.struct(F.col("speaker").alias("s"), mentioned.alias("m"))).over(in_order())
    ok = F.coalesce((F.col("_p.s") == fixed.AGENT) & (F.col("_p.m") == F.col("speaker")), F.lit(False))
    return history.withColumn("_p", asked).withColumn("solicited", ok).where(F.col("speaker") != fixed.AGENT).drop("_p")


def latest(history: DataFrame, ok: Column, value: Column) -> DataFrame:
    """The value of each trial's latest entry that satisfies ok; nothing is merged."""
    return history.where(ok).groupBy("trial").agg(F.max_by(value, F.col("seq")).alias("value"), F.max("seq").alias("seq"))


def merged_turns(history: DataFrame, side: Column) -> DataFrame:
    """Neighbouring entries of one side become a turn; their texts are joined by line feeds."""
    turn = F.sum(F.when(F.col("_before") == F.col("_side"), 0).otherwise(1)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    cut = history.withColumn("_side", side).withColumn("_before", F.lag("_side").over(in_order())).withColumn("turn", turn)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n")
    return cut.groupBy("trial", "turn").agg(F.first("_side").alias("side"), F.min("seq").alias("first_seq"), F.count("*").alias("n"), told.alias("content"))


def alternated(turns: DataFrame, first: str, between: str) -> DataFrame:
    """A placeholder before an assistant's turn that opens the trial, or that follows another assistant's."""
    over = Window.partitionBy("trial").orderBy("seq")
    before = F.lag("kind").over(over)
    extra = F.when(F.col("kind") == "assistant", F.when(before.isNull(), first).when(before == "assistant", between))
    rows = turns.withColumn("_extra", extra)
    made = F.when(F.col("_extra").isNotNull(), F.array(F.struct(F.lit("user").alias("kind"), F.col("_extra").alias("content"), F.lit(0).alias("part")))).otherwise(F.array())
    own = F.array(F.struct("kind", "content", F.lit(1).alias("part")))
    return rows.withColumn("_r", F.explode(F.concat(made, own))).select("trial", "seq", F.col("_r.part").alias("part"), F.col("_r.kind").alias("kind"), F.col("_r.content").alias("content"))


def transcript(history: DataFrame, line: Column, keep: Column | None = None) -> DataFrame:
    """A trial's lines in order, joined by line feeds."""
    rows = history if keep is None else history.where(keep)
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return rows.groupBy("trial").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def two_edits(markers: DataFrame, known: list[str]) -> DataFrame:
    """Of each speaker's markers in order, those whose path is known, at first as it is and else below one
    of the sections; the first MAX_EDITS_PER_USER of them apply, later ones don't."""
    paths = [F.col("path"), *[F.concat(F.lit(p), F.col("path")) for p in fixed.PATH_PREFIXES]]
    real = F.coalesce(*[F.when(p.isin(known), p) for p in paths])
    place = F.sum(F.when(F.col("real_path").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("trial", "speaker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return markers.withColumn("real_path", real).withColumn("applied", F.col("real_path").isNotNull() & (place <= fixed.MAX_EDITS_PER_USER))
