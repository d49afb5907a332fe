"""Tool-call logs: pairing, repeats, cache coverage, nearest examples, argument checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.functions import fixed, jsonx, times
from tripfold.operators.ordered import Running, running


def paired(log: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Calls with the kind and text of the entry that follows."""
    both = running(log, keys, order, [Running("next_kind", "next", F.col("kind")), Running("next_text", "next", F.col("text"))], chunk)
    return both.where("kind = 'tool_call'").withColumn("result", F.when(F.col("next_kind") == "tool_result", F.col("next_text"))).drop("next_kind", "next_text")


def third_calls(calls: DataFrame, keys: list[str], order: list[str], chunk: Column, n: int = 3) -> DataFrame:
    """The n-th occurrence of the same call."""
    return running(calls, keys, order, [Running("_seen", "sum", F.lit(1))], chunk).where(F.col("_seen") == n - 1).drop("_seen")


def repeated_rounds(calls: DataFrame, trial: str, round_: str, sig: Column) -> DataFrame:
    """T5: rounds that share a call with the round before. Rounds meet by call, so no round's calls are gathered."""
    seen = calls.select(trial, round_, sig.alias("_sig")).distinct()
    rounds = calls.select(trial, round_).distinct()
    before = rounds.withColumn("_before", F.lag(round_).over(Window.partitionBy(trial).orderBy(round_)))
    now = seen.join(before, [trial, round_])
    old = seen.select(F.col(trial).alias("_t"), F.col(round_).alias("_r"), F.col("_sig").alias("_s"))
    hit = now.join(old, (F.col(trial) == F.col("_t")) & (F.col("_before") == F.col("_r")) & (F.col("_sig") == F.col("_s")), "left_semi")
    flags = hit.select(trial, round_).distinct().withColumn("_hit", F.lit(True))
    return rounds.join(flags, [trial, round_], "left").select(trial, round_, F.coalesce("_hit", F.lit(False)).alias("repeated"))


def stopped(flags: DataFrame, trial: str, round_: str) -> DataFrame:
    """Rounds that are repetitive, as the one before was."""
    before = F.lag("repeated").over(Window.partitionBy(trial).orderBy(round_))
    return flags.withColumn("_b", before).where("repeated and _b").drop("_b")


def cache_lookup(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls with the cached result of the same tool and key, and hit."""
    return calls.join(cache, ["tool", "cache_key"], "left").withColumn("hit", F.col("result").isNotNull())


def cache_status(cache: DataFrame, missed: DataFrame) -> DataFrame:
    """For each tool how many keys are cached and how many calls were missed."""
    a = cache.groupBy("tool").agg(F.count("*").alias("cached"))
    b = missed.groupBy("tool").agg(F.count("*").alias("missed"))
    return a.join(b, "tool", "full_outer").select("tool", F.coalesce("cached", F.lit(0)).alias("cached"), F.coalesce("missed", F.lit(0)).alias("missed"))


def call_counters(calls: DataFrame, trial: str) -> DataFrame:
    """Executed, hits, misses and errors of each trial's calls(malformed, failed, hit, has_error).

    Arguments that are no JSON are an error and never reach the cache; a call that is refused or ends in an
    exception (failed) is a miss and an error; of the others the cache tells hit or miss, and the result
    whether it is an error. Nulls are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    malformed, failed = flag("malformed"), ~flag("malformed") & flag("failed")
    ran = ~malformed & ~failed
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return calls.groupBy(trial).agg(
        F.count("*").alias("executed"), one(ran & flag("hit")).alias("hits"), one(failed | (ran & ~flag("hit"))).alias("misses"), one(malformed | failed | (ran & flag("has_error"))).alias("errors")
    )


def uncovered(missed: DataFrame, cache: DataFrame) -> DataFrame:
    """Missed calls that the cache still lacks."""
    return missed.join(cache, ["tool", "cache_key"], "left_anti")


def unit(vector: str) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / norm)


BLOCKS = 64


def nearest(queries: DataFrame, examples: DataFrame, k: int = fixed.EXAMPLES_PER_MISS) -> DataFrame:
    """For each query (tool, query, qvec) the k nearest examples (tool, example, evec) by cosine.

    A tool's examples are dealt into blocks by hash; each block gives its k best for each query, and the
    best of those are the result, so no task ranks all examples of a tool.
    """
    blocks = examples.select("tool", "example", unit("evec").alias("_e"), F.pmod(F.xxhash64("example"), F.lit(BLOCKS)).alias("_block"))
    asked = queries.select("tool", "query", unit("qvec").alias("_q"))
    score = F.aggregate(F.zip_with("_q", "_e", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = asked.join(blocks, "tool").select("tool", "query", "example", "_block", score.alias("score"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "example")
    local = scored.withColumn("_n", F.row_number().over(best("tool", "query", "_block"))).where(F.col("_n") <= k)
    return local.withColumn("rank", F.row_number().over(best("tool", "query"))).where(F.col("rank") <= k).select("tool", "query", "example", "score", "rank")


def sample_examples(examples: DataFrame, k: int, seed: str) -> DataFrame:
    """K examples of each tool in the order of a seeded hash; blocks first, as in nearest."""
    order = F.md5(F.concat(F.col("example").cast("string"), F.lit(seed)).cast("binary"))
    hashed = examples.select("tool", "example", order.alias("_h"), F.pmod(F.xxhash64("example"), F.lit(BLOCKS)).alias("_block"))
    local = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("tool", "_block").orderBy("_h"))).where(F.col("_n") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("tool").orderBy("_h"))).where(F.col("rank") <= k).select("tool", "example", "rank")


# --- T13: what a call's arguments must satisfy, as rows of a table
_ROUTE = [("filled", "origin"), ("place", "origin"), ("filled", "destination"), ("place", "destination")]
_TRAVEL = [("filled", "origin"), ("city", "origin"), ("filled", "destination"), ("city", "destination"), ("date", "date"), ("clock", "depart_time_start"), ("clock", "depart_time_end"), ("ordered", "depart_time_start", "depart_time_end")]
VALUE_RULES = {
    "maps_geo": [("filled", "address")],
    "maps_weather": [("filled", "location"), ("city", "location"), ("date", "date"), ("range", "days", 0, fixed.MAX_WEATHER_DAYS)],
    "travel_search_flights": [*_TRAVEL, ("one_of", "sort_by", fixed.SORT_VALUES["travel_search_flights"])],
    "travel_search_trains": [*_TRAVEL, ("one_of", "sort_by", fixed.SORT_VALUES["travel_search_trains"]), ("one_of", "train_type_filter", fixed.TRAIN_FILTERS)],
    "web_search": [("filled", "query")],
    "search_poi": [
        ("filled", "keywords"), ("filled", "city"), ("city", "city"), ("one_of", "sort_by", fixed.SORT_VALUES["search_poi"]), ("range", "page_size", 1, fixed.MAX_PAGE_SIZE),
        ("range", "page", 1, None), ("above", "radius_km", 0), ("range", "price_min", 0, None), ("range", "price_max", 0, None), ("ordered", "price_min", "price_max"),
        ("filled", "location"), ("place", "location"),
    ],
    "get_poi_detail": [("filled", "id")],
    "plan_route": [*_ROUTE, ("one_of", "mode", fixed.ROUTE_MODES["plan_route"]), ("date", "date"), ("clock", "time"), ("city", "city"), ("needs", "mode", "transit", "city")],
    "compare_routes": [*_ROUTE, ("city", "city")],
    "search_along_route": [
        *_ROUTE, ("filled", "keywords"), ("one_of", "mode", fixed.ROUTE_MODES["search_along_route"]), ("range", "route_range", 1, fixed.MAX_ROUTE_RANGE),
        ("range", "route_index", 1, None), ("range", "poi_limit", 1, fixed.MAX_ROUTE_POIS), ("city", "city"),
    ],
}
RULE = "tool string, ord int, rule string, name string, texts array<string>, low double, high double, code string"
_FITS = {"string": ["string"], "integer": ["integer", "boolean"], "number": ["integer", "number", "boolean"]}


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules of the ten tools (see RULE): a row for each, in the order in which they are tried."""
    rows = []
    for tool, params in fixed.TOOL_PARAMS.items():
        own = [("known", None, list(params), None, None, "unknown_argument"), ("required", None, list(fixed.TOOL_REQUIRED[tool]), None, None, "missing_argument")]
        own += [("kind", name, [*_FITS[kind], *["null"] * null], None, None, "wrong_type") for name, (kind, null) in params.items()]
        for rule, name, *more in VALUE_RULES[tool]:
            texts, low, high = None, None, None
            if rule in ("range", "above"):
                low, high = (None if x is None else float(x) for x in (more + [None])[:2])
            elif more:
                texts = list(more[0]) if rule == "one_of" else list(more)
            own.append((rule, name, texts, low, high, f"{rule}:{name}"))
        rows += [(tool, k, *r) for k, r in enumerate(own)]
    return spark.createDataFrame(rows, RULE)


def _broken(r: Column) -> Column:
    """Whether the call breaks rule r, on the call's maps by argument: _kind, _text and _number. What is said of a
    value holds for one that is there and not null."""
    name, texts = r["name"], r["texts"]
    text, number = F.try_element_at("_text", name), F.try_element_at("_number", name)
    other = F.get(texts, F.lit(0))
    of_value = (
        F.when(r["rule"] == "filled", F.trim(text) == "")
        .when(r["rule"] == "city", ~F.coalesce(F.array_contains("_cities", name), F.lit(False)))
        .when(r["rule"] == "date", times.date_error(text))
        .when(r["rule"] == "clock", times.clock_error(text))
        .when(r["rule"] == "place", F.trim(text).rlike(r"^\d{3}") & times.coordinate_error(F.trim(text)))
        .when(r["rule"] == "one_of", ~F.array_contains(texts, text))
        .when(r["rule"] == "range", (number < r["low"]) | F.coalesce(number > r["high"], F.lit(False)))
        .when(r["rule"] == "above", number <= r["low"])
        .when(r["rule"] == "ordered", F.coalesce(number > F.try_element_at("_number", other), text > F.try_element_at("_text", other), F.lit(False)))
        .when(r["rule"] == "needs", (text == other) & F.coalesce(F.trim(F.try_element_at("_text", F.get(texts, F.lit(1)))) == "", F.lit(True)))
    )
    keys = F.map_keys("_kind")
    return F.coalesce(
        F.when(r["rule"] == "known", F.size(F.array_except(keys, texts)) > 0).when(r["rule"] == "required", F.size(F.array_except(texts, keys)) > 0)
        .when(r["rule"] == "kind", ~F.array_contains(texts, F.try_element_at("_kind", name))).when(text.isNotNull(), of_value),
        F.lit(False),
    )


def validate_calls(calls: DataFrame, key: str, cities: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Key, ok and the code of the first rule that the call's arguments break.

    cities(name): known place names; an argument names a city if it is one as it is or with a suffix. rules
    (see RULE): those of the ten tools unless others are given. A tool has few rules, so each call gets its
    tool's as a list, from a broadcast; they are tried where the call is, without a shuffle. New rules of
    these kinds are new rows.
    """
    rules = rules_table(calls.sparkSession) if rules is None else rules
    listed = rules.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "name", "texts", "low", "high", "code"))).alias("_rules"))
    v = calls.select(key, "tool", jsonx.strict_variant("arguments").alias("_v"))
    m = v.select(key, "tool", F.col("_v").isNull().alias("_bad"), jsonx.as_map(F.col("_v")).alias("_m"))
    kind = F.transform_values("_m", lambda k, x: F.coalesce(jsonx.variant_kind(x), F.lit("null")))
    number = F.transform_values("_m", lambda k, x: F.try_variant_get(x, "$", "double"))
    rows = m.select(key, "tool", "_bad", kind.alias("_kind"), F.transform_values("_m", lambda k, x: jsonx.as_text(x)).alias("_text"), number.alias("_number"))
    rows = rows.join(F.broadcast(listed), "tool", "left")  # a few rows a tool
    named = F.transform(F.filter("_rules", lambda r: r["rule"] == "city"), lambda r: r["name"])
    asked = rows.select(key, F.explode(F.filter(F.transform(named, lambda n: F.struct(n.alias("n"), F.try_element_at("_text", n).alias("v"))), lambda a: a["v"].isNotNull())).alias("_a"))
    tried = asked.select(key, F.col("_a.n").alias("_n"), F.explode(F.array(F.col("_a.v"), *[F.concat(F.col("_a.v"), F.lit(s)) for s in fixed.CITY_TRY_SUFFIXES])).alias("name"))
    good = tried.join(cities.select("name").distinct(), "name", "left_semi").groupBy(key).agg(F.collect_set("_n").alias("_cities"))  # a few names a call
    first = F.get(F.filter("_rules", _broken), F.lit(0))["code"]
    code = F.when(F.col("_bad"), "bad_json").when(F.col("_kind").isNull(), "not_an_object").when(F.col("_rules").isNull(), "unknown_tool").otherwise(first)
    return rows.join(good, key, "left").withColumn("code", code).select(key, F.col("code").isNull().alias("ok"), "code")
