"""Places and names: exact and substring matches, opening hours, administrative names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed, text, times


def grams(text: str) -> Column:
    """The distinct characters and pairs of neighbouring characters of a text."""
    at = F.sequence(F.lit(1), F.length(text))
    one = F.transform(at, lambda i: F.substr(text, i, F.lit(1)))
    two = F.transform(F.filter(at, lambda i: i < F.length(text)), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(F.length(text) > 0, F.array_distinct(F.concat(one, two))).otherwise(F.array().cast("array<string>"))


def match_places(places: DataFrame, poi: DataFrame) -> DataFrame:
    """For each (city, place) the stored name that equals it, else the shortest one of the city that
    contains it; the first stored wins ties. No row for a place without a match.

    poi(city, name, ord). A name that contains a place has the place's first pair of characters (its
    character, if it is one), so that pair is a join key and no place meets all names of its city.
    """
    asked = places.select("city", "place").where("place <> ''").distinct()
    poi = poi.groupBy("city", "name").agg(F.min("ord").alias("ord"))  # a name stored more than once counts as the first
    exact = asked.join(poi.select("city", F.col("name").alias("place"), "ord", F.col("name").alias("matched")), ["city", "place"])
    rest = asked.join(exact, ["city", "place"], "left_anti").withColumn("gram", F.left("place", F.lit(2)))
    names = poi.select("city", "name", "ord", F.explode(grams("name")).alias("gram"))
    found = rest.join(names, ["city", "gram"]).where(F.contains("name", "place"))
    best = found.groupBy("city", "place").agg(F.min(F.struct(F.length("name").alias("_l"), "ord", "name")).alias("_b"))
    return exact.select("city", "place", "matched", "ord").unionByName(best.select("city", "place", F.col("_b.name").alias("matched"), F.col("_b.ord").alias("ord")))


def place_category(kind: Column, category: Column) -> Column:
    """A hotel's category outside the list, a category on its kind's list of exclusions, and an empty
    one become the kind's fallback."""
    blank = category.isNull() | (F.trim(category) == "")
    out = F.when(kind == "hotels", F.when(~blank & category.isin(*fixed.HOTEL_CATEGORIES), category).otherwise(fixed.FALLBACK_CATEGORIES["hotels"]))
    for k, bad in fixed.EXCLUDED_CATEGORIES.items():
        out = out.when(kind == k, F.when(blank | category.isin(*bad), fixed.FALLBACK_CATEGORIES[k]).otherwise(category))
    return out.otherwise(category)


def first_stored(poi: DataFrame, name: str, ord_: str, value: Column) -> DataFrame:
    """Of each name the value that was stored first."""
    return poi.groupBy(name).agg(F.min_by(value, F.col(ord_)).alias("value"))


def in_season(day: Column, start: Column, end: Column) -> Column:
    """Whether a month and day is in a season; one that ends before it starts runs over New Year."""
    return F.when(start <= end, day.between(start, end)).otherwise((day >= start) | (day <= end))


def within_opening(visits: DataFrame, rules: DataFrame) -> DataFrame:
    """Visits with open: whether start and end are within one window of the rule that holds on the
    date, null without a rule. The first rule in season holds; closed on weekdays that it lacks. A rule
    without windows is passed over. Times are compared as texts.

    visits(visit, place, d, s, e); rules(place, rule_ix, season_start, season_end, weekdays, windows).
    """
    day = times.month_day(F.col("d"))
    hit = visits.join(rules, "place").where(in_season(day, F.col("season_start"), F.col("season_end")))
    wrong_day = ~F.array_contains("weekdays", times.iso_weekday(F.col("d")))
    hit = hit.withColumn("_closed", wrong_day).where(F.col("_closed") | (F.size("windows") > 0))
    first = hit.groupBy("visit").agg(F.min_by(F.struct("_closed", "windows", "s", "e"), "rule_ix").alias("_r"))
    inside = F.exists("_r.windows", lambda w: (F.col("_r.s") >= w["open"]) & (F.col("_r.e") <= w["close"]))
    return visits.join(first.select("visit", (~F.col("_r._closed") & inside).alias("open")), "visit", "left")


def full_names(admin: DataFrame) -> DataFrame:
    """admin(name, code) with the full name: the names of its province and city, then its own."""
    up = lambda n: F.rpad(F.substring("code", 1, n), 6, "0")
    names = admin.where(F.col("name") != fixed.PLACEHOLDER_SUFFIX)
    p = names.select(F.col("code").alias("_pc"), F.col("name").alias("_pn"))
    c = names.select(F.col("code").alias("_cc"), F.col("name").alias("_cn"))
    both = admin.withColumn("_p", up(2)).withColumn("_c", up(4))
    both = both.join(p, (F.col("_p") == F.col("_pc")) & (F.col("_p") != F.col("code")), "left").join(c, (F.col("_c") == F.col("_cc")) & ~F.col("_c").isin(F.col("code"), F.col("_p")), "left")
    return both.select("name", "code", F.concat(F.coalesce("_pn", F.lit("")), F.coalesce("_cn", F.lit("")), F.col("name")).alias("full_name"))


def resolve_names(names: DataFrame, admin: DataFrame) -> DataFrame:
    """Asked names with code and status: exact, unique (the one full name that ends in it), ambiguous or
    none. Every suffix of a full name is one row, so the join is on equality.

    names(asked); admin(name, code, full_name).
    """
    suffixes = admin.select("code", "full_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("full_name")), lambda i: F.substr("full_name", i))).alias("asked"))
    hit = names.select("asked").distinct().join(suffixes, "asked")
    g = hit.groupBy("asked").agg(
        F.min(F.when(F.col("full_name") == F.col("asked"), F.col("code"))).alias("_exact"), F.countDistinct("code").alias("_n"),
        F.min_by("code", F.struct(F.length("full_name"), "full_name")).alias("_first"),
    )
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    code = F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_first")))
    return names.select("asked").distinct().join(g, "asked", "left").select("asked", code.alias("code"), status.alias("status"))


def known_names(names: DataFrame, admin: DataFrame, suffixes: tuple = ("", *fixed.CITY_TRY_SUFFIXES)) -> DataFrame:
    """The asked names that are a name, as they are or with a suffix."""
    tried = names.select("asked", F.explode(F.array(*[F.concat("asked", F.lit(s)) for s in suffixes])).alias("name"))
    return tried.join(admin.select("name").distinct(), "name", "left_semi").select("asked").distinct()


def conflicting_names(admin: DataFrame) -> DataFrame:
    """Full names that stand for more than one code, with how many; such a table is to be refused."""
    return admin.groupBy("full_name").agg(F.countDistinct("code").alias("codes")).where("codes > 1")


def terminal_names(names: DataFrame, admin: DataFrame, suffixes: tuple = fixed.TERMINAL_SUFFIXES) -> DataFrame:
    """Asked names with valid, reason, n (full names that end in it) and first (the shortest of them, then by
    code points).

    A name is refused if it is blank, if it holds two of the suffixes or more, or if text follows one. Else it
    counts if a full name ends in it; if none does, those that end in it and a suffix count. reason: blank,
    levels, compound, unknown or ok.

    names(asked); admin(code, full_name). Every suffix of a full name is one row, so the join is on equality.
    """
    asked = names.select("asked").distinct().withColumn("_name", text.strip("asked"))
    held = F.filter(F.array(*map(F.lit, suffixes)), lambda s: F.contains("_name", s))
    follows = F.exists(held, lambda s: F.instr(F.col("_name"), s) + F.length(s) <= F.length("_name"))  # from its first place
    shape = F.when(F.col("_name") == "", "blank").when(F.size(held) > 1, "levels").when(follows, "compound")
    shaped = asked.withColumn("_shape", shape)
    ends = admin.select("full_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("full_name")), lambda i: F.substr("full_name", i))).alias("_end")).distinct()
    good = shaped.where("_shape is null")
    tried = good.select("asked", F.posexplode(F.array(F.col("_name"), *[F.concat("_name", F.lit(s)) for s in suffixes])).alias("_try", "_end"))
    hit = tried.join(ends, "_end").withColumn("_plain", F.col("_try") == 0)
    any_plain = hit.groupBy("asked").agg(F.bool_or("_plain").alias("_p"), *[f.alias(n) for n, f in _matches(F.col("_plain"), "a")], *[f.alias(n) for n, f in _matches(~F.col("_plain"), "b")])
    found = any_plain.select("asked", F.when(F.col("_p"), F.col("_na")).otherwise(F.col("_nb")).alias("_n"), F.when(F.col("_p"), F.col("_fa")).otherwise(F.col("_fb")).alias("_first"))
    out = shaped.join(found, "asked", "left")
    reason = F.coalesce("_shape", F.when(F.col("_n") > 0, "ok").otherwise("unknown"))
    return out.select("asked", (reason == "ok").alias("valid"), reason.alias("reason"), F.coalesce("_n", F.lit(0)).alias("n"), F.col("_first").alias("first"))


def _matches(which: Column, name: str) -> list[tuple[str, Column]]:
    return [(f"_n{name}", F.count(F.when(which, 1))), (f"_f{name}", F.min_by("full_name", F.when(which, F.struct(F.length("full_name"), "full_name"))))]
