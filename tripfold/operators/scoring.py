"""Flattened plans, preferences and their scores, completeness, judge responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed, ratings
from tripfold.functions.columns import bind


def flattened(plans: DataFrame, days: str) -> DataFrame:
    """Days -> segments -> activities, one row each with its places in the lists."""
    d = plans.select("trial", F.posexplode_outer(days).alias("day_ix", "_d"))
    s = d.select("trial", "day_ix", F.col("_d.date").alias("date"), F.posexplode_outer("_d.segments").alias("seg_ix", "_s"))
    return s.select("trial", "day_ix", "date", "seg_ix", F.col("_s.city").alias("city"), F.posexplode_outer("_s.activities").alias("act_ix", "act"))


def participants(who: Column, everyone: Column) -> Column:
    """A missing or empty list and ["All"] mean everyone."""
    return F.when(who.isNull() | (F.size(who) == 0) | (who == F.array(F.lit("All"))), everyone).otherwise(who)


def must_scores(visits: DataFrame, wishes: DataFrame) -> DataFrame:
    """Once per wish: its place is part of a visited one's name; must gives +2, reject -2.

    visits(person, place); wishes(person, kind, item).
    """
    hit = visits.select("person", "place").distinct().join(wishes, "person").where(F.contains("place", "item")).select("person", "kind", "item").distinct()
    return hit.withColumn("score", F.when(F.col("kind") == "must", fixed.STRONG).otherwise(-fixed.STRONG))


def tier(value: Column, must: Column, reject: Column, prefer: Column, avoid: Column) -> Column:
    """Must and reject may both count; prefer or avoid only if neither does."""
    has = lambda xs: F.coalesce(F.array_contains(xs, value), F.lit(False))
    strong = F.when(has(must), fixed.STRONG).otherwise(0) - F.when(has(reject), fixed.STRONG).otherwise(0)
    weak = F.when(has(prefer), fixed.WEAK).when(has(avoid), -fixed.WEAK).otherwise(0)
    return F.when(has(must) | has(reject), strong).otherwise(weak)


def first_tier(value: Column, prefer: Column, avoid: Column) -> Column:
    """Prefer, else avoid; null where there is neither list."""
    has = lambda xs: F.coalesce(F.array_contains(xs, value), F.lit(False))
    none = (F.size(F.coalesce(prefer, F.array())) == 0) & (F.size(F.coalesce(avoid, F.array())) == 0)
    return F.when(~none, F.when(has(prefer), fixed.WEAK).when(has(avoid), -fixed.WEAK).otherwise(0))


def fairness(scores: DataFrame, trial: str, score: str) -> DataFrame:
    """Least and greatest score of each trial's persons, and their ratio in percent."""
    g = scores.groupBy(trial).agg(F.min(score).alias("low"), F.max(score).alias("high"))
    return g.withColumn("fairness", ratings.fairness("low", "high"))


def compare_lists(pairs: DataFrame, agent: str, ref: str) -> DataFrame:
    """Of the reference's items how many the agent has, and the other way round; lists of no reference item don't count."""
    a, r = F.coalesce(agent, F.array()), F.col(ref)
    return pairs.where(F.size(r) > 0).select(
        "*", F.size(F.filter(r, lambda x: F.array_contains(a, x))).alias("collected"), F.size(r).alias("possible"),
        F.size(F.filter(a, lambda x: F.array_contains(r, x))).alias("correct"), F.size(a).alias("agent_total"),
        F.size(F.array_except(r, a)).alias("missed"), F.size(F.array_except(a, r)).alias("spurious"),
    )


def compare_scalars(pairs: DataFrame, agent: str, ref: str) -> DataFrame:
    """Equal or not, where the reference isn't 0; a missing report is a reported 0."""
    same = F.coalesce(agent, F.lit(0)) == F.col(ref)
    one = F.when(same, 1).otherwise(0)
    return pairs.where(F.col(ref) != 0).select("*", one.alias("collected"), F.lit(1).alias("possible"), one.alias("correct"), F.lit(1).alias("agent_total"))


def prf(matches: DataFrame, by: str) -> DataFrame:
    """Recall, precision and F1; 1 where nothing was possible or reported."""
    g = matches.groupBy(by).agg(*[F.sum(c).cast("double").alias(c) for c in ("collected", "possible", "correct", "agent_total")])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(b, F.lit(0.0))), F.lit(1.0))
    g = g.withColumn("recall", share("collected", "possible")).withColumn("precision", share("correct", "agent_total"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return g.select(by, "recall", "precision", f1.alias("f1"))


_INNER = ("response", "reasoning", "rating", "meta_evaluation")


def repaired(text: Column, dims: tuple) -> Column:
    """A judge's response without code fence and comments, without spaces within tags, and with near names of
    dimensions made right: a tag that is none of the known ones but part of a dimension's name, or the other way
    round, is the first such dimension's."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)^\s*```\w*\s*|\s*```\s*\z", "")
    bare = F.regexp_replace(bare, r"<\s*(/?)\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*>", "<$1$2>")

    def renamed(given: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(given, F.lit(r"</?([a-zA-Z_][a-zA-Z0-9_]*)>"), 1))
        odd = F.filter(names, lambda t: ~t.isin(*dims, *_INNER))
        near = F.transform(odd, lambda t: F.named_struct(F.lit("t"), t, F.lit("d"), F.get(F.filter(F.array(*map(F.lit, dims)), lambda d: F.contains(d, t) | F.contains(t, d)), F.lit(0))))
        swap = lambda acc, x: F.replace(F.replace(acc, F.concat(F.lit("<"), x["t"], F.lit(">")), F.concat(F.lit("<"), x["d"], F.lit(">"))), F.concat(F.lit("</"), x["t"], F.lit(">")), F.concat(F.lit("</"), x["d"], F.lit(">")))
        return F.aggregate(F.filter(near, lambda x: x["d"].isNotNull()), given, swap)

    return bind(bare, renamed)


def judge_fields(df: DataFrame, key: str, response: str, dims: tuple) -> DataFrame:
    """Key, dim, reasoning and rating from a judge's tagged response (see repaired).

    Each dimension is read by itself, so a missing wrapper or a bare angle bracket elsewhere does no harm. One
    that isn't closed ends where the next begins; a reasoning that isn't closed ends at the rating, a rating
    with its dimension. Entities are read as their characters. A dimension or part that isn't there is null.
    """
    rows = df.select(key, repaired(F.col(response), dims).alias("_text"), F.explode(F.array(*map(F.lit, dims))).alias("dim"))
    opens = F.concat(F.lit("<"), "dim", F.lit(">"))
    rest = rows.withColumn("_rest", F.when(F.contains("_text", opens), F.substr("_text", F.instr(F.col("_text"), opens) + F.length(opens))))
    ends = F.concat(F.lit("</"), "dim", F.lit(">"))
    others = F.expr("array_join(filter(array(" + ", ".join(f"'{d}'" for d in dims) + "), x -> x <> dim), '|')")
    until = F.concat(F.lit("(?s)\\A(.*?)(?:<(?:"), others, F.lit(")>|</response>|\\z)"))
    part = F.when(F.contains("_rest", ends), F.expr("substring_index(_rest, concat('</', dim, '>'), 1)")).otherwise(F.expr("regexp_extract(_rest, _until, 1)"))
    out = rest.withColumn("_until", until).withColumn("_part", part)
    inner = lambda tag, stop: F.when(F.contains("_part", F.lit(f"<{tag}>")), F.regexp_extract("_part", f"(?s)<{tag}>(.*?)(?:</{tag}>|{stop}\\z)", 1))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    told = lambda c: F.nullif(F.trim(plain(c)), F.lit(""))
    return out.select(key, "dim", told(inner("reasoning", "<rating>|")).alias("reasoning"), told(inner("rating", "")).alias("rating"))


def dimension_stats(scores: DataFrame, dim: str, score: str) -> DataFrame:
    """Mean, least, greatest and number of each dimension's scores, nulls left out."""
    return scores.groupBy(dim).agg((F.sum(score).cast("double") / F.count(score)).alias("mean"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("n"))


def is_plan(plan: Column) -> Column:
    """Whether a VARIANT is a plan: a non-empty list of days, the first an object with a non-empty list of segments."""
    days = F.try_variant_get(plan, "$.days", "array<variant>")
    segments = F.try_variant_get(plan, "$.days[0].city_segments", "array<variant>")
    return F.coalesce((F.size(days) > 0) & (F.size(segments) > 0), F.lit(False))


def is_preference_table(table: Column) -> Column:
    """Whether a VARIANT is an object whose every value is an object with one of the two sections at least."""
    m = F.try_variant_get(table, "$", "map<string,variant>")
    sections = [p.rstrip(".") for p in fixed.PATH_PREFIXES]
    inner = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    good = F.forall(F.map_values(m), lambda v: F.coalesce(F.arrays_overlap(inner(v), F.array(*map(F.lit, sections))), F.lit(False)))
    return F.coalesce((F.cardinality(m) > 0) & good, F.lit(False))


def category_scores(visits: DataFrame, wishes: DataFrame) -> DataFrame:
    """Per visit +1 or -1: a liked name or category, a disliked one; a name counts before a category.

    visits(visit, person, place, category), only resolved places; wishes(person, positive, negative).
    """
    named = lambda xs: F.exists(xs, lambda x: F.contains("place", x))
    kind = lambda xs: F.coalesce(F.array_contains(xs, F.col("category")), F.lit(False))
    score = (
        F.when(named("positive"), fixed.WEAK).when(named("negative"), -fixed.WEAK)
        .when(kind("positive"), fixed.WEAK).when(kind("negative"), -fixed.WEAK)
    )
    return visits.where("category is not null").join(wishes, "person").withColumn("score", score).where("score is not null").select("visit", "person", "score")


DIMENSIONS = ("attraction", "food", "transport", "hotel", "intensity", "budget")


def utility(items: DataFrame, penalties: DataFrame, people: DataFrame) -> DataFrame:
    """For each trial the score of each dimension, all scores, the penalty, the total less it and its share a person.

    items(trial, person, dimension, score); penalties(trial, penalty); people(trial, person).
    """
    n = people.groupBy("trial").agg(F.count("*").alias("people"))
    by = items.groupBy("trial").pivot("dimension", list(DIMENSIONS)).agg(F.sum("score"))
    lost = penalties.groupBy("trial").agg(F.sum("penalty").alias("penalty"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = n.join(by, "trial", "left").join(lost, "trial", "left")
    out = out.select("trial", "people", *[zero(d).alias(d) for d in DIMENSIONS], zero("penalty").alias("penalty"))
    out = out.withColumn("total", sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) - F.col("penalty"))
    return out.withColumn("utility", F.col("total").cast("double") / F.col("people"))
