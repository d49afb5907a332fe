"""Scores of plans by each user's preferences (U1 to U10), on the tables of plans.py and preferences.py.

wishes are preferences.items: trial, usr, city, field, kind, ord, value. Scores come as trial, usr,
dimension, field, score, with the place or the item that they are about in about. A missing name is an empty
one; a name contains an empty wish. Places are resolved once for each city and name (lookups.match_places).

Both sides of a join by trial grow with the trials, and Spark may guess the size of what is unfolded from a row, or
read from a compressed table, far too low. So these joins are hinted to merge: neither side is ever broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed, times
from tripfold.operators import lookups
from tripfold.operators.itinerary import with_conflict
from tripfold.operators.plans import DAY
from tripfold.operators.scoring import DIMENSIONS, fairness, participants
from tripfold.session import written

ACT = [*DAY, "seg_ix", "act_ix"]
SCORE = ["trial", "usr", "dimension", "field", "about", "score"]


def activity_users(acts: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each activity and known user who takes part, once."""
    everyone = users.groupBy("trial").agg(F.array_sort(F.collect_set("usr")).alias("_all"))
    rows = acts.withColumn("location", F.coalesce("location", F.lit(""))).join(everyone.hint("merge"), "trial")
    return rows.withColumn("usr", F.explode(F.array_intersect(participants(F.col("who"), F.col("_all")), F.col("_all")))).drop("_all")


def without_conflicts(taking: DataFrame) -> DataFrame:
    """activity_users without activities that overlap another one of any of their users in the segment; what
    has the same day, place (where there is none, goal) and start goes with them, for everybody."""
    found = with_conflict(taking.select(*DAY, "day", "seg_ix", "usr", F.col("act_ix").alias("ix"), "typ", "st", "en", "_place", "start_time"), [*DAY, "seg_ix", "usr"])
    bad = found.where("conflict").select("trial", F.col("day").alias("_day"), F.col("_place").alias("_p"), F.col("start_time").alias("_s")).distinct()
    same = (F.col("day") == F.col("_day")) & F.col("_place").eqNullSafe(F.col("_p")) & F.col("start_time").eqNullSafe(F.col("_s"))
    return taking.alias("t").join(bad.hint("merge").alias("b"), (F.col("t.trial") == F.col("b.trial")) & same, "left_anti")


def _placed(acts: DataFrame, users: DataFrame) -> DataFrame:
    """activity_users with the place (where there is none, the goal), written since conflicts take it more than once."""
    place = F.when(F.col("location").isNotNull(), F.col("location")).otherwise(F.col("to"))
    return written(activity_users(acts.withColumn("_place", place), users))


def scorable(acts: DataFrame, users: DataFrame) -> DataFrame:
    return without_conflicts(_placed(acts, users)).drop("_place")


def categories(acts: DataFrame, poi: DataFrame) -> DataFrame:
    """City, place, matched name, category and poi_type of the acts' places that the catalogue has.

    poi(city, name, ord, poi_type, category).
    """
    asked = acts.select("city", F.col("location").alias("place")).distinct()
    found = lookups.match_places(asked, poi)
    told = poi.groupBy(F.col("city").alias("_c"), F.col("name").alias("_n")).agg(F.max_by(F.struct("poi_type", "category"), "ord").alias("_d"))  # the last stored of a name
    full = found.join(told, (F.col("city") == F.col("_c")) & (F.col("matched") == F.col("_n")))
    return full.select("city", "place", "matched", F.col("_d.poi_type").alias("poi_type"), lookups.place_category(F.col("_d.poi_type"), F.col("_d.category")).alias("category"))


def _scores(df: DataFrame, dimension: str, field: Column, about: str, score: Column) -> DataFrame:
    return df.select("trial", "usr", F.lit(dimension).alias("dimension"), field.alias("field"), F.col(about).alias("about"), score.cast("int").alias("score"))


def _listed(wishes: DataFrame, fields: dict[str, str], city: bool) -> DataFrame:
    """A row for each user (and city) with an array for each of the fields, empty where there is none."""
    keys = ["trial", "usr", "city"] if city else ["trial", "usr"]
    mine = wishes.where((F.col("kind") == "list") & F.col("field").isin(*fields.values()))
    lists = {n: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("ord", "value")))) for n, f in fields.items()}  # a user's list is as long as it was said
    got = mine.groupBy(*keys).agg(*[c.alias(n) for n, c in lists.items()])
    return got.select(*keys, *[F.transform(n, lambda x: x["value"]).alias(n) for n in fields]).hint("merge")


def _has(xs: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(xs, value), F.lit(False))


def _first(xs: str) -> Column:
    """The first wish of a list that the place's name contains."""
    return F.get(F.filter(xs, lambda x: F.contains("location", x)), F.lit(0))


def named(taking: DataFrame, wishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Once for each wish whose place a visited attraction of its city names: +2 or -2. And the places so named."""
    visits = taking.where("typ = 'attraction'").select("trial", "usr", "city", "location").distinct()
    asked = wishes.where("field in ('attractions.must_visit', 'attractions.reject_visit')")
    hit = visits.join(asked.hint("merge"), ["trial", "usr", "city"]).where(F.contains("location", "value"))
    once = hit.select("trial", "usr", "city", "field", "ord", "value").distinct()
    score = F.when(F.col("field") == "attractions.must_visit", fixed.STRONG).otherwise(-fixed.STRONG)
    return _scores(once, "attraction", F.col("field"), "value", score), hit.select("trial", "usr", "city", "location").distinct()


def liked(taking: DataFrame, wishes: DataFrame, known: DataFrame, taken: DataFrame) -> DataFrame:
    """For each visit to a known attraction that U1 didn't name (taken): +1 if a liked word is in its name or its
    category is liked, and -1 likewise."""
    visits = taking.where("typ = 'attraction'").join(taken.hint("merge"), ["trial", "usr", "city", "location"], "left_anti")
    visits = visits.join(known.select("city", F.col("place").alias("location"), "category"), ["city", "location"])
    both = visits.join(_listed(wishes, {"positive": "attractions.category_pref.positive", "negative": "attractions.category_pref.negative"}, True), ["trial", "usr", "city"])
    category = F.col("category")
    found = [F.struct(F.lit(f"attractions.category_pref.{n}").alias("field"), F.when(F.exists(n, lambda x: F.contains("location", x)) | _has(n, category), s).alias("score")) for n, s in (("positive", fixed.WEAK), ("negative", -fixed.WEAK))]
    rows = both.withColumn("_s", F.explode(F.array(*found))).where("_s.score is not null")
    return _scores(rows, "attraction", F.col("_s.field"), "location", F.col("_s.score"))


def meals(taking: DataFrame, wishes: DataFrame, known: DataFrame) -> DataFrame:
    """For each meal at a known place the first list, of must, reject, prefer and avoid, with a word in its name;
    without one, by its category: must and reject may both count, prefer or avoid only if neither does."""
    fields = {n: f"food.{n}_eat" for n in ("must", "reject", "prefer", "avoid")}
    worth = {"must": fixed.STRONG, "reject": -fixed.STRONG, "prefer": fixed.WEAK, "avoid": -fixed.WEAK}
    eaten = taking.where("typ = 'food'").join(known.select("city", F.col("place").alias("location"), "category"), ["city", "location"])
    both = eaten.join(_listed(wishes, fields, True), ["trial", "usr", "city"])
    one = lambda n: F.struct(F.lit(fields[n]).alias("field"), F.lit(worth[n]).alias("score"))
    by_name = reduce(lambda c, n: c.when(_first(n).isNotNull(), one(n)), list(fields)[1:], F.when(_first("must").isNotNull(), one("must")))
    category = F.col("category")
    strong = F.array_compact(F.array(F.when(_has("must", category), one("must")), F.when(_has("reject", category), one("reject"))))
    weak = F.when(_has("prefer", category), one("prefer")).when(_has("avoid", category), one("avoid"))
    by_category = F.when(F.size(strong) > 0, strong).otherwise(F.array_compact(F.array(weak)))
    rows = both.withColumn("_n", by_name).withColumn("_s", F.explode(F.when(F.col("_n").isNotNull(), F.array("_n")).otherwise(by_category)))
    return _scores(rows, "food", F.col("_s.field"), "location", F.col("_s.score"))


def modes(segments: DataFrame, wishes: DataFrame) -> DataFrame:
    """U4: for each leg and user the lists with its mode: must and reject may both count, prefer or avoid only if neither does."""
    fields = {n: f"transport.{n}" for n in ("must", "reject", "prefer", "avoid")}
    legs = segments.where("kind = 'intercity' and transport_mode <> ''").select("trial", F.col("transport_mode").alias("mode"))
    both = legs.join(_listed(wishes, fields, False), "trial")
    mode = F.col("mode")
    one = lambda n, s: F.struct(F.lit(fields[n]).alias("field"), F.lit(s).alias("score"))
    strong = F.array_compact(F.array(F.when(_has("must", mode), one("must", fixed.STRONG)), F.when(_has("reject", mode), one("reject", -fixed.STRONG))))
    weak = F.when(_has("prefer", mode), one("prefer", fixed.WEAK)).when(_has("avoid", mode), one("avoid", -fixed.WEAK))
    rows = both.withColumn("_s", F.explode(F.when(F.size(strong) > 0, strong).otherwise(F.array_compact(F.array(weak)))))
    return _scores(rows, "transport", F.col("_s.field"), "mode", F.col("_s.score"))


def stays(acts: DataFrame, wishes: DataFrame, known: DataFrame) -> DataFrame:
    """For each night at a known hotel and each user: +1 if its category is preferred, else -1 if it is to be avoided."""
    nights = acts.where("typ = 'hotel'").select("trial", "city", F.coalesce("location", F.lit("")).alias("location")).join(known.select("city", F.col("place").alias("location"), "category"), ["city", "location"])
    both = nights.where("category <> ''").join(_listed(wishes, {"prefer": "hotel_preference.prefer", "avoid": "hotel_preference.avoid"}, False), "trial")
    score = F.when(_has("prefer", F.col("category")), fixed.WEAK).when(_has("avoid", F.col("category")), -fixed.WEAK)
    field = F.when(score > 0, "hotel_preference.prefer").otherwise("hotel_preference.avoid")
    return _scores(both, "hotel", field, "location", score).where("score is not null")


def _caps(wishes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Each user's numbers: a column for each field, null where it is missing."""
    mine = wishes.where((F.col("kind") == "scalar") & F.col("field").isin(*fields.values())).withColumn("_x", F.col("value").try_cast("double"))
    return mine.groupBy("trial", "usr").agg(*[F.max(F.when(F.col("field") == f, F.col("_x"))).alias(n) for n, f in fields.items()]).hint("merge")


def pace(taking: DataFrame, wishes: DataFrame) -> DataFrame:
    """-2 for each day on which a user sees more attractions, or spends more hours on them and on the way, than
    their own caps; 0 is no cap. Conflicts count here."""
    lasts = times.duration(F.col("st"), F.col("en"))
    active = F.when(F.col("typ").isin("attraction", "intracity_transport"), lasts).otherwise(0)
    g = taking.groupBy(*DAY, "usr").agg(F.sum(F.when(F.col("typ") == "attraction", 1).otherwise(0)).alias("places"), F.sum(active).alias("minutes"), F.max("day").alias("day"))
    rows = g.join(_caps(wishes, {"most": "intensity.max_poi_per_day", "hours": "intensity.max_active_hours"}), ["trial", "usr"])
    over = F.array_compact(F.array(F.when((F.col("most") > 0) & (F.col("places") > F.col("most")), "intensity.max_poi_per_day"), F.when((F.col("hours") > 0) & (F.col("minutes") > F.col("hours") * 60), "intensity.max_active_hours")))
    return _scores(rows.withColumn("_f", F.explode(over)).withColumn("about", F.col("day").cast("string")), "intensity", F.col("_f"), "about", F.lit(-fixed.STRONG))


def spending(segments: DataFrame, acts: DataFrame, taking: DataFrame, users: DataFrame) -> DataFrame:
    """trial, usr and what each user spends, by kind: legs and hotels are everybody's, meals those who eat's.
    Costs that are no number count nothing."""
    cost = F.col("cost").try_cast("decimal(18,2)")
    shared = segments.where("kind = 'intercity'").select("trial", F.lit("leg").alias("_k"), cost.alias("_c")).unionByName(acts.where("typ = 'hotel'").select("trial", F.lit("hotel").alias("_k"), cost.alias("_c")))
    shared = shared.groupBy("trial").agg(*[F.sum(F.when(F.col("_k") == k, F.col("_c"))).alias(f"{k}s") for k in ("leg", "hotel")])
    own = taking.where("typ = 'food'").groupBy("trial", "usr").agg(F.sum(cost).alias("meals"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,2)")).cast("decimal(28,2)").alias(c)
    rows = users.select("trial", "usr").distinct().join(shared.hint("merge"), "trial", "left").join(own.hint("merge"), ["trial", "usr"], "left")
    return rows.select("trial", "usr", zero("legs"), zero("hotels"), zero("meals")).withColumn("spent", F.col("legs") + F.col("hotels") + F.col("meals"))


def budget(spent: DataFrame, wishes: DataFrame) -> DataFrame:
    """-2 for each user who spends more than their budget; 0 is no budget."""
    rows = spent.join(_caps(wishes, {"most": "avg_budget"}), ["trial", "usr"]).where("most <> 0 and spent > most")
    return _scores(rows.withColumn("about", F.lit(None).cast("string")), "budget", F.lit("avg_budget"), "about", F.lit(-fixed.STRONG))


def all_scores(segments: DataFrame, acts: DataFrame, users: DataFrame, wishes: DataFrame, poi: DataFrame) -> DataFrame:
    """U1 to U7 of every user. What more than one of them takes is written."""
    taking, known = _placed(acts, users), written(categories(acts.withColumn("location", F.coalesce("location", F.lit(""))), poi))
    clean = written(without_conflicts(taking).drop("_place"))
    by_name, taken = named(clean, wishes)
    parts = [by_name, liked(clean, wishes, known, taken), meals(clean, wishes, known), modes(segments, wishes), stays(acts, wishes, known), pace(taking, wishes), budget(spending(segments, acts, taking, users), wishes)]
    return reduce(DataFrame.unionByName, [p.select(SCORE) for p in parts])


def per_user(scores: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each user with the sum of each dimension and of all, 0 where there is none."""
    by = scores.groupBy("trial", "usr").pivot("dimension", list(DIMENSIONS)).agg(F.sum("score"))
    out = users.select("trial", "usr").distinct().join(by.hint("merge"), ["trial", "usr"], "left").select("trial", "usr", *[F.coalesce(d, F.lit(0)).cast("long").alias(d) for d in DIMENSIONS])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(d) for d in DIMENSIONS]))


def utility(each: DataFrame, scored: DataFrame, penalties: DataFrame) -> DataFrame:
    """For each trial the total before and after the penalty, and its share a user.

    each: per_user; scored(trial, usr): the users who have preferences, others count neither way;
    penalties(trial, penalty). A trial without any such user has its penalty alone, as of one user.
    """
    lost = penalties.groupBy("trial").agg(F.sum("penalty").alias("penalty"))
    mine = each.join(scored.select("trial", "usr").distinct().hint("merge"), ["trial", "usr"], "left_semi").groupBy("trial").agg(F.sum("total").alias("before"), F.count("*").alias("n_users"))
    out = each.select("trial").distinct().join(mine.hint("merge"), "trial", "left").join(lost.hint("merge"), "trial", "left")
    out = out.select("trial", F.coalesce("n_users", F.lit(0)).alias("n_users"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("penalty", F.lit(0)).cast("long").alias("penalty"))
    out = out.withColumn("total", F.col("before") - F.col("penalty"))
    return out.withColumn("utility", F.col("total").cast("double") / F.greatest("n_users", F.lit(1)))


def plan_fairness(each: DataFrame) -> DataFrame:
    """Over the sums of all users, those without preferences among them."""
    return fairness(each, "trial", "total")
