"""Plans: from JSON text to days, segments, activities and a timeline, and the checks along them.

Everything follows the places in the plan's lists (day_ix, seg_ix, act_ix), never the clock. A plan is one
input row, so a trial's day is bounded by it; the running checks also take a chunk (see ordered.py) for
timelines that don't come from one row.

A list of participants that is no list counts as everybody's here; wrong_participants reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.functions import fixed, jsonx, text, times
from tripfold.operators.itinerary import islands
from tripfold.operators.ordered import Running, running
from tripfold.operators.scoring import participants

PLACED = ("attraction", "food", "hotel")
DAY = ["trial", "day_ix"]
ORDER = ["seg_ix", "act_ix", "who_ix"]


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: str, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def days(plans: DataFrame) -> DataFrame:
    """Trial, day_ix, day, date and _segments of each day of plans(trial, plan VARIANT). A plan without a
    list of days has none."""
    d = plans.select("trial", F.posexplode(_list(F.col("plan"), "$.days")).alias("day_ix", "_d"))
    day = F.coalesce(F.try_variant_get("_d", "$.day", "bigint"), F.lit(0).cast("long"))
    return d.select("trial", "day_ix", day.alias("day"), _text("_d", "date").alias("date"), _list(F.col("_d"), "$.city_segments").alias("_segments"))


def segments(days_: DataFrame) -> DataFrame:
    """The days' segments. kind: intercity or city; has_city, has_acts: whether the segment has such a key."""
    s = days_.select(*DAY, "day", "date", F.posexplode("_segments").alias("seg_ix", "_s"))
    keys = F.map_keys(jsonx.as_map(F.col("_s")))
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(_text("_s", "type") == "intercity_transport", "intercity").otherwise("city")
    named = [_text("_s", c).alias(c) for c in ("city", "from_city", "to_city", "transport_mode", "start_time", "end_time")]
    return (
        s.select(*DAY, "day", "date", "seg_ix", kind.alias("kind"), *named, _text("_s", "avg_cost").alias("cost"), has("city").alias("has_city"), has("activities").alias("_acts_key"), _list(F.col("_s"), "$.activities").alias("_acts"))
        .withColumn("has_acts", F.col("_acts_key") & (F.col("kind") == "city")).withColumn("st", times.minutes("start_time")).withColumn("en", times.minutes("end_time")).drop("_acts_key")
    )


def activities(segments_: DataFrame) -> DataFrame:
    """The activities of the city segments. who: names, null if there is no list; who_kind: the JSON kind of
    what the plan says, null if it says nothing."""
    a = segments_.where("has_acts").select(*DAY, "day", "date", "seg_ix", "city", F.posexplode("_acts").alias("act_ix", "_a"))
    said = F.try_variant_get("_a", "$.participants", "variant")
    kind = F.nullif(jsonx.variant_kind(said), F.lit("null"))
    who = F.when(kind == "array", F.try_variant_get("_a", "$.participants", "array<string>"))
    named = [_text("_a", c).alias(c) for c in ("location", "from", "to", "start_time", "end_time")]
    return (
        a.select(*DAY, "day", "date", "seg_ix", "act_ix", "city", F.coalesce(_text("_a", "type"), F.lit("")).alias("typ"), *named, _text("_a", "avg_cost").alias("cost"), who.alias("who"), kind.alias("who_kind"))
        .withColumn("st", times.minutes("start_time")).withColumn("en", times.minutes("end_time"))
    )


def place(end: bool) -> Column:
    """where an activity starts or ends; null for a rest and other types, which don't move anybody."""
    return F.when(F.col("typ").isin(*PLACED), F.col("location")).when(F.col("typ") == "intracity_transport", F.col("to" if end else "from"))


def timeline(segments_: DataFrame, acts: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each activity or leg and person, in list order (ORDER). Legs take everybody.

    users(trial, usr). starts, ends: places; who_ix: the person's place in the list.
    """
    everyone = users.groupBy("trial").agg(F.array_sort(F.collect_set("usr")).alias("_all"))  # a group's few people; too many groups to broadcast
    columns = [*DAY, "day", "seg_ix", "act_ix", "who_ix", "usr", "typ", "city", "starts", "ends", "st", "en"]
    none = F.lit(None).cast("string")
    legs = segments_.where("kind = 'intercity'").join(everyone.hint("merge"), "trial").select("*", F.posexplode("_all").alias("who_ix", "usr"))
    legs = legs.select(*DAY, "day", "seg_ix", F.lit(-1).alias("act_ix"), "who_ix", "usr", F.lit("intercity_transport").alias("typ"), none.alias("city"), none.alias("starts"), none.alias("ends"), "st", "en")
    own = acts.withColumn("starts", place(False)).withColumn("ends", place(True)).join(everyone.hint("merge"), "trial", "left")
    own = own.select("*", F.posexplode(participants(F.col("who"), F.col("_all"))).alias("who_ix", "usr"))
    return legs.select(columns).unionByName(own.select(columns))


def transfers(line: DataFrame, chunk: Column | None = None) -> DataFrame:
    """V7: activities at another place than the person's last one, and transfers that begin elsewhere.

    A person is where the last activity with a place ended. A leg between cities leaves everybody at a hub,
    which only a transfer leaves without an issue. Names count as they are listed, unknown and repeated ones
    too. Each step only replaces the place or keeps it, so steps compose, and chunks of a day are summarised
    by their last place.
    """
    at = lambda hub, where: F.struct(F.lit(hub).alias("hub"), where.alias("place"))
    now = (
        F.when(F.col("typ") == "intercity_transport", at(True, F.lit(None).cast("string")))
        .when(F.col("ends").isNotNull() & ~((F.col("typ") == "hotel") & (F.col("ends") == "")), at(False, F.col("ends")))
    )
    rows = running(line, [*DAY, "usr"], ORDER, [Running("_at", "last", now)], chunk)
    moved = F.col("starts").isNotNull() & (F.col("starts") != F.col("_at.place"))
    issue = (
        F.when(F.col("_at").isNull() | F.col("typ").isin("intercity_transport", "rest"), None)
        .when(F.col("_at.hub"), F.when(F.col("typ") != "intracity_transport", "missing_intracity_transport"))
        .when(moved, F.when(F.col("typ") == "intracity_transport", "intracity_transport_origin_mismatch").otherwise("missing_intracity_transport"))
    )
    return rows.select(*DAY, "day", *ORDER, "usr", "city", issue.alias("issue"), F.col("_at.place").alias("from_place"), F.col("starts").alias("to_place")).where("issue is not null")


def backwards(line: DataFrame, users: DataFrame, chunk: Column | None = None) -> DataFrame:
    """V8: a person's activities and legs that start before the end of an earlier one in the list.

    A hotel doesn't move the clock on, and neither does an end before its start.
    """
    own = line.join(users.select("trial", "usr").distinct().hint("merge"), ["trial", "usr"], "left_semi")
    own = own.groupBy(*DAY, "usr", "seg_ix", "act_ix").agg(*[F.first(c).alias(c) for c in ("day", "typ", "st", "en")])  # a name listed twice is one person
    end = F.when((F.col("typ") != "hotel") & (F.col("st").isNull() | (F.col("en") >= F.col("st"))), F.col("en"))
    rows = running(own, [*DAY, "usr"], ["seg_ix", "act_ix"], [Running("clock", "last", end)], chunk)
    return rows.where("st < clock").select(*DAY, "day", "usr", "seg_ix", "act_ix", "typ", "st", "clock")


def _apart(a: str, b: str) -> Column:
    """Whether two city names aren't the same city's."""
    return ~F.col(a).eqNullSafe(F.col(b)) & ~text.city_key(a).eqNullSafe(text.city_key(b))


def day_cities(days_: DataFrame, segments_: DataFrame) -> DataFrame:
    """First and last city of each day, by list order; a leg counts as the city it goes to. Days without any have nulls."""
    seen = segments_.where("kind = 'intercity' or has_city")
    leg = F.when(F.col("kind") == "intercity", F.col("to_city"))
    ends = seen.groupBy(*DAY).agg(
        F.min_by(F.coalesce(leg, F.when(F.col("kind") == "city", F.col("city"))), "seg_ix").alias("first_city"), F.max_by(F.when(F.col("has_city"), F.col("city")).otherwise(leg), "seg_ix").alias("last_city")
    )
    return days_.select(*DAY, "day").join(ends, DAY, "left")


def city_changes(days_: DataFrame, segments_: DataFrame) -> DataFrame:
    """V1, V2: cities entered without a leg, within a day and from one day to the next.

    Names that differ by an administrative suffix are one city. A day that begins with a leg may begin anywhere.
    """
    seen = segments_.where("kind = 'intercity' or has_city").withColumn("_here", F.when(F.col("kind") == "intercity", F.coalesce("to_city", F.lit(""))).otherwise(F.col("city")))
    rows = running(seen, DAY, ["seg_ix"], [Running("from_place", "prev", F.col("_here"))])
    within = rows.where((F.col("kind") == "city") & F.col("from_place").isNotNull() & _apart("from_place", "city"))
    within = within.select(*DAY, "day", "seg_ix", F.col("from_place").alias("from_city"), F.col("city").alias("to_city"))
    begins = segments_.groupBy(*DAY).agg(F.min_by("kind", "seg_ix").alias("_begins"))
    night = F.lag("last_city").over(Window.partitionBy("trial").orderBy("day_ix"))
    over = day_cities(days_, segments_).withColumn("from_city", night).join(begins, DAY, "left")
    over = over.where("from_city <> '' and first_city <> ''").where(_apart("from_city", "first_city") & (F.coalesce("_begins", F.lit("")) != "intercity"))
    return within.unionByName(over.select(*DAY, "day", F.lit(None).cast("int").alias("seg_ix"), "from_city", F.col("first_city").alias("to_city")))


def nights_without_hotel(days_: DataFrame, segments_: DataFrame, acts: DataFrame) -> DataFrame:
    """V3: days but a plan's last whose last block of activities doesn't end with a hotel, and why: there is no
    hotel (no block, or an empty one, counts as that), or it isn't the last activity."""
    last_day = days_.groupBy("trial").agg(F.max("day_ix").alias("_end"))
    block = segments_.where("has_acts").groupBy(*DAY).agg(F.max("seg_ix").alias("_block"))
    found = acts.groupBy(*DAY).agg(F.max_by(F.struct("seg_ix", "typ"), F.struct("seg_ix", "act_ix")).alias("_last"), F.bool_or(F.col("typ") == "hotel").alias("_any"))
    rows = days_.select(*DAY, "day").join(last_day, "trial").where("day_ix < _end").join(block, DAY, "left").join(found, DAY, "left")
    empty = F.col("_block").isNull() | ~F.col("_last.seg_ix").eqNullSafe(F.col("_block"))
    issue = F.when(empty, "missing_hotel").when(F.col("_last.typ") != "hotel", F.when(F.col("_any"), "hotel_not_last_activity").otherwise("missing_hotel"))
    return rows.select(*DAY, "day", issue.alias("issue")).where("issue is not null")


def time_issues(segments_: DataFrame, acts: DataFrame) -> DataFrame:
    """V4: legs and activities with a start or end that is no time, and activities that don't end after they
    start; hotels don't count, and legs may go past midnight."""
    legs = segments_.where("kind = 'intercity'").select(*DAY, "day", "seg_ix", F.lit(-1).alias("act_ix"), F.lit("intercity_transport").alias("typ"), "st", "en")
    both = legs.unionByName(acts.where("typ <> 'hotel'").select(*DAY, "day", "seg_ix", "act_ix", "typ", "st", "en"))
    bad = F.col("st").isNull() | F.col("en").isNull()
    issue = F.when(bad, "invalid_time_format").when((F.col("en") <= F.col("st")) & (F.col("act_ix") >= 0), "invalid_time_range")
    return both.select(*DAY, "day", "seg_ix", "act_ix", "typ", issue.alias("issue")).where("issue is not null")


def missing_costs(segments_: DataFrame, acts: DataFrame) -> DataFrame:
    """V9: legs, meals and hotels without a cost."""
    legs = segments_.where("kind = 'intercity' and cost is null").select(*DAY, "day", "seg_ix", F.lit(-1).alias("act_ix"), F.lit("intercity_transport").alias("typ"))
    return legs.unionByName(acts.where("typ in ('food', 'hotel') and cost is null").select(*DAY, "day", "seg_ix", "act_ix", "typ"))


def wrong_participants(acts: DataFrame, users: DataFrame) -> DataFrame:
    """Participants that are no list, an empty list, or nobody of the group, a row for each such name.
    Hotels don't count, nor activities that say nothing."""
    told = acts.where("typ <> 'hotel' and who_kind is not null").select(*DAY, "day", "seg_ix", "act_ix", "who", "who_kind")
    shape = F.when(F.col("who_kind") != "array", "not_a_list").when(F.size("who") == 0, "empty")
    none = F.lit(None).cast("string")
    odd = told.withColumn("issue", shape).where("issue is not null").select(*DAY, "day", "seg_ix", "act_ix", "issue", none.alias("who_ix").cast("int").alias("who_ix"), none.alias("name"))
    names = told.where("who_kind = 'array'").select(*DAY, "day", "seg_ix", "act_ix", F.posexplode("who").alias("who_ix", "name")).where(~F.col("name").eqNullSafe(F.lit("All")))
    known = users.select("trial", F.col("usr").alias("name")).distinct()
    unknown = names.join(known, ["trial", "name"], "left_anti").withColumn("issue", F.lit("unknown"))
    return odd.unionByName(unknown.select(odd.columns))


def split_penalty(acts: DataFrame) -> DataFrame:
    """U8: of each group of overlapping activities of a segment that teams of their own do, the number of teams
    less one, if no one is in two of them.

    Only types that a group may do apart count, with a list of participants other than ["All"]. A team is the
    set of names. Teams share nobody if they have as many names together as apart; they are counted without
    being gathered.
    """
    apart = acts.where(F.col("typ").isin(*fixed.SPLITTABLE_TYPES) & (F.size("who") > 0) & (F.col("who") != F.array(F.lit("All"))))
    team = apart.select(*DAY, "day", "seg_ix", F.col("act_ix").alias("ix"), "typ", "st", "en", F.array_sort(F.array_distinct("who")).alias("team"))
    key = [*DAY, "seg_ix", "island"]
    teams = islands(team, [*DAY, "seg_ix"]).select(*key, "day", "team").distinct()
    counts = teams.groupBy(*key, "day").agg(F.count("*").alias("teams"), F.sum(F.size("team")).alias("_apart"))
    together = teams.select(*key, F.explode("team").alias("name")).distinct().groupBy(*key).agg(F.count("*").alias("_together"))
    split = counts.where("teams > 1").join(together.hint("merge"), key).where("_apart = _together")
    return split.select(*DAY, "day", "seg_ix", F.col("island").cast("long").alias("island"), "teams", (F.col("teams") - 1).alias("penalty"))
