"""Flattened activities: overlaps, islands, running checks, intensity, budgets and issues.

Groups are keyed by a person and a day. The running checks cut each group by the hour (see ordered.py),
so a group of any size is shared out among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed
from tripfold.operators.ordered import Running, running


def timed(acts: DataFrame) -> DataFrame:
    """The activities that can overlap others: not a hotel, and not overnight."""
    return acts.where((F.col("typ") != "hotel") & (F.col("en") > F.col("st")))


def overlap_pairs(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a group's activities that overlap, as keys, ix_a < ix_b.

    Activities meet by the hours that they cover, and a pair counts in the first hour that both cover.
    """
    cells = timed(acts).withColumn("_hour", F.explode(F.sequence(F.expr("st div 60"), F.expr("(en - 1) div 60"))))
    a, b = cells.alias("a"), cells.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_hour"]]
    hit = (F.col("a.ix") < F.col("b.ix")) & (F.col("a.st") < F.col("b.en")) & (F.col("b.st") < F.col("a.en"))
    first = F.col("a._hour") == F.greatest(F.expr("a.st div 60"), F.expr("b.st div 60"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return a.join(b, on & hit & first).select(*[F.col(f"a.{k}") for k in keys], F.col("a.ix").alias("ix_a"), F.col("b.ix").alias("ix_b"))


def with_conflict(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Acts and conflict, whether an activity overlaps another of its group, without making pairs.

    In order of start, an earlier activity overlaps if the running greatest end is past the start, a
    later one if the next start is before the end.
    """
    can = timed(acts)
    seen = running(can, keys, ["st", "ix"], [Running("_end", "max", F.col("en")), Running("_next", "next", F.col("st"))], F.expr("st div 60"))
    hit = F.coalesce(F.col("_end") > F.col("st"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("en"), F.lit(False))
    rest = acts.where(~((F.col("typ") != "hotel") & (F.col("en") > F.col("st")))).withColumn("conflict", F.lit(False))
    return seen.withColumn("conflict", hit).drop("_end", "_next").unionByName(rest)


def islands(acts: DataFrame, keys: list[str]) -> DataFrame:
    """The timed activities with island, a number per group for each maximal run of overlapping ones."""
    hour = F.expr("st div 60")
    ends = running(timed(acts), keys, ["st", "ix"], [Running("_end", "max", F.col("en"))], hour)
    new = F.when(F.col("_end").isNull() | (F.col("_end") <= F.col("st")), 1).otherwise(0)
    return running(ends, keys, ["st", "ix"], [Running("island", "sum_upto", new)], hour).drop("_end")


def split_penalty(acts: DataFrame, segment: list[str], team: str) -> DataFrame:
    """U8: of each island with two teams or more, the number of teams less one.

    Teams are told apart by the column team, whose members are disjoint.
    """
    kinds = acts.where(F.col("typ").isin(*fixed.SPLITTABLE_TYPES))
    return islands(kinds, segment).groupBy(*segment, "island").agg(F.countDistinct(team).alias("teams")).where("teams > 1").withColumn("penalty", F.col("teams") - 1)


def backwards(acts: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """V8: activities that start before the end of one before them in the list (order), not on the clock.

    A hotel doesn't move the clock on, and neither does an end before its start. chunk: see running.
    """
    end = F.when((F.col("typ") != "hotel") & (F.col("en") >= F.col("st")), F.col("en"))
    return running(acts, keys, order, [Running("_last", "last", end)], chunk).where("st < _last").drop("_last")


def misplaced(acts: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """V7 without transfers and hubs (plans.transfers has them): activities at another place than the last one
    known, in list order; a rest has no place."""
    place = F.when(F.col("typ") != "rest", F.col("loc"))
    return running(acts, keys, order, [Running("came_from", "last", place)], chunk).where((F.col("typ") != "rest") & (F.col("came_from") != F.col("loc")))


def place_changes(acts: DataFrame, keys: list[str], place: str, order: list[str], chunk: Column) -> DataFrame:
    """V1 without legs (plans.city_changes has them): activities whose place differs from that of the one before in the list."""
    return running(acts, keys, order, [Running("before", "prev", F.col(place))], chunk).where(F.col("before") != F.col(place))


def day_ends(acts: DataFrame, keys: list[str], place: str, order: list[str]) -> DataFrame:
    """First and last place of each group, by list order."""
    at = F.struct(*order)
    return acts.groupBy(*keys).agg(F.min_by(place, at).alias("first_place"), F.max_by(place, at).alias("last_place"))


def nights_without_hotel(acts: DataFrame, person: str, day: str, order: list[str]) -> DataFrame:
    """V3: days but a person's last that have no hotel, or whose last activity in the list isn't one."""
    days = acts.groupBy(person, day).agg(F.bool_or(F.col("typ") == "hotel").alias("any"), F.max_by("typ", F.struct(*order)).alias("last"))
    end = days.groupBy(F.col(person).alias("_p")).agg(F.max(day).alias("_end"))
    issue = F.when(~F.col("any"), "no_hotel").when(F.col("last") != "hotel", "hotel_not_last")
    return days.join(end, F.col(person) == F.col("_p")).where(F.col(day) < F.col("_end")).select(person, day, issue.alias("issue")).where("issue is not null")


def intensity(acts: DataFrame, keys: list[str], places: int, minutes: int) -> DataFrame:
    """Groups with more attractions or more active minutes than allowed, -2 for each."""
    active = F.when(F.col("typ").isin("attraction", "intracity_transport"), F.greatest(F.col("en") - F.col("st"), F.lit(0))).otherwise(0)
    g = acts.groupBy(*keys).agg(F.sum(F.when(F.col("typ") == "attraction", 1).otherwise(0)).alias("places"), F.sum(active).alias("minutes"))
    score = F.when(F.col("places") > places, -fixed.STRONG).otherwise(0) + F.when(F.col("minutes") > minutes, -fixed.STRONG).otherwise(0)
    return g.withColumn("score", score).where("score < 0")


def time_issues(acts: DataFrame, start: Column, end: Column) -> DataFrame:
    """V4: activities with a start or end that is no time, or an end that isn't past the start; hotels don't count."""
    issue = F.when(start.isNull() | end.isNull(), "bad_time").when(end <= start, "end_before_start")
    return acts.where(F.col("typ") != "hotel").withColumn("issue", issue).where("issue is not null")


def issue_rollup(issues: DataFrame, trials: DataFrame, trial: str) -> DataFrame:
    """For each trial whether it is valid, and its issues in all and by type."""
    counts = issues.groupBy(trial, "issue").agg(F.count("*").alias("_n"))
    per = counts.groupBy(F.col(trial).alias("_t")).agg(F.sum("_n").alias("_all"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "_n")))).alias("_by"))
    none = F.create_map().cast("map<string,bigint>")
    return trials.join(per, F.col(trial) == F.col("_t"), "left").select(
        trial, F.col("_all").isNull().alias("valid"), F.coalesce("_all", F.lit(0)).alias("total"), F.coalesce("_by", none).alias("counts")
    )
