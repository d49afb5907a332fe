"""Queries of the tool-call family: events as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripfold.functions import fixed, jsonx
from tripfold.operators import toolcalls as T
from tripfold.plans.adapters import CALLS, calls, table

QUERIES, SQL = {}, {}
CALL = ["trial", "tool", "arguments"]


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(f"""WITH {CALLS}, l AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'tool_call' WHEN seq % 3 = 1 THEN 'tool_result' ELSE 'message' END AS kind FROM cal),
n AS (SELECT *, lead(kind) OVER w AS nk, lead(arguments) OVER w AS nt FROM l WINDOW w AS (PARTITION BY trial, d ORDER BY hr, ts, seq))
SELECT trial, seq, CASE WHEN nk = 'tool_result' THEN nt END AS result FROM n WHERE kind = 'tool_call'""")
def q_pair(spark, sf_dir):
    m = F.col("seq") % 3
    log = calls(spark, sf_dir).withColumn("kind", F.when(m == 0, "tool_call").when(m == 1, "tool_result").otherwise("message")).withColumn("text", F.col("arguments"))
    return T.paired(log, ["trial", "d"], ["hr", "ts", "seq"], F.col("hr")).select("trial", "seq", "result")


@query(f"WITH {CALLS} SELECT trial, tool, arguments, seq FROM (SELECT *, row_number() OVER (PARTITION BY trial, tool, arguments ORDER BY d, ts, seq) AS n FROM cal) WHERE n = 3")
def q_repeat3(spark, sf_dir):
    return T.third_calls(calls(spark, sf_dir), CALL, ["d", "ts", "seq"], F.col("d")).select(*CALL, "seq")


_ROUNDS = f"""WITH {CALLS}, s AS (SELECT DISTINCT trial, d, tool FROM cal), r AS (SELECT trial, d, lag(d) OVER (PARTITION BY trial ORDER BY d) AS b FROM (SELECT DISTINCT trial, d FROM s)),
f AS (SELECT trial, d AS round, EXISTS (SELECT 1 FROM s x JOIN s y ON x.trial = y.trial AND x.tool = y.tool WHERE x.trial = r.trial AND x.d = r.d AND y.d = r.b) AS repeated FROM r)"""


@query(_ROUNDS + " SELECT trial, round, repeated FROM f")
def q_repeat(spark, sf_dir):
    """T5: a day is a round, a call its tool."""
    return T.repeated_rounds(calls(spark, sf_dir).withColumn("round", F.col("d")), "trial", "round", F.col("tool"))


@query(_ROUNDS + " SELECT trial, round FROM (SELECT *, lag(repeated) OVER (PARTITION BY trial ORDER BY round) AS b FROM f) WHERE repeated AND b")
def q_stopped(spark, sf_dir):
    """T7."""
    flags = T.repeated_rounds(calls(spark, sf_dir).withColumn("round", F.col("d")), "trial", "round", F.col("tool"))
    return T.stopped(flags, "trial", "round").select("trial", "round")


@query(f"WITH {CALLS} SELECT seq, seq % 4 = 1 AS malformed FROM cal")
def q_jsonbad(spark, sf_dir):
    """Every fourth call has a text behind its object."""
    args = F.when(F.col("seq") % 4 == 1, F.concat("arguments", F.lit(" x"))).otherwise(F.col("arguments"))
    return calls(spark, sf_dir).select("seq", jsonx.strict_variant(args).isNull().alias("malformed"))


_PARAMS = """p AS (SELECT seq, CASE seq % 3 WHEN 0 THEN concat('{"b":', regexp_extract(arguments, '([0-9]+)', 1), ',"a":"x"}')
  WHEN 1 THEN concat('{"a":"x", "b":', regexp_extract(arguments, '([0-9]+)', 1), '}') ELSE 'not json' END AS raw, regexp_extract(arguments, '([0-9]+)', 1) AS n FROM cal)"""


def _params(spark, sf_dir):
    n, m = F.regexp_extract("arguments", "([0-9]+)", 1), F.col("seq") % 3
    raw = F.when(m == 0, F.concat(F.lit('{"b":'), n, F.lit(',"a":"x"}'))).when(m == 1, F.concat(F.lit('{"a":"x", "b":'), n, F.lit("}"))).otherwise("not json")
    return calls(spark, sf_dir).select("seq", raw.alias("raw"))


@query(f"""WITH {CALLS}, {_PARAMS} SELECT seq, CASE WHEN seq % 3 = 2 THEN raw ELSE concat('[["a","x"],["b",', n, ']]') END AS key,
  CASE WHEN seq % 3 = 2 THEN raw ELSE concat('{{"a":"x","b":', n, '}}') END AS params FROM p""")
def q_key(spark, sf_dir):
    """The key doesn't depend on the order of arguments, and gives them back; other texts stay."""
    key = jsonx.cache_key("raw")
    return _params(spark, sf_dir).select("seq", key.alias("key"), F.coalesce(jsonx.params_of(key), key).alias("params"))


@query(f"WITH {CALLS}, {_PARAMS} SELECT seq, CASE WHEN seq % 3 = 2 THEN raw ELSE concat('a: x | b: ', n) END AS text FROM p")
def q_ptext(spark, sf_dir):
    return _params(spark, sf_dir).select("seq", jsonx.params_text("raw").alias("text"))


_CACHE = f"""WITH {CALLS}, k AS (SELECT *, concat('[["k",', regexp_extract(arguments, '([0-9]+)', 1), ']]') AS cache_key FROM cal),
cache AS (SELECT tool, cache_key, max(arguments) AS result FROM k WHERE early GROUP BY tool, cache_key), late AS (SELECT * FROM k WHERE NOT early)"""


def _cache(spark, sf_dir):
    k = calls(spark, sf_dir).withColumn("cache_key", jsonx.cache_key("arguments"))
    return k.where("early").groupBy("tool", "cache_key").agg(F.max("arguments").alias("result")), k.where("not early").select("tool", "cache_key", "seq")


@query(_CACHE + " SELECT late.tool, count(*) AS calls, count(result) AS hits FROM late LEFT JOIN cache ON late.tool = cache.tool AND late.cache_key = cache.cache_key GROUP BY late.tool")
def q_cache(spark, sf_dir):
    """J9."""
    cache, late = _cache(spark, sf_dir)
    return T.cache_lookup(late, cache).groupBy("tool").agg(F.count("*").alias("calls"), F.count("result").alias("hits"))


@query(_CACHE + ", c AS (SELECT tool, count(*) AS cached FROM cache WHERE tool <> 'error' GROUP BY tool), m AS (SELECT tool, count(*) AS missed FROM late WHERE tool <> 'view' GROUP BY tool) SELECT coalesce(c.tool, m.tool) AS tool, coalesce(cached, 0) AS cached, coalesce(missed, 0) AS missed FROM c FULL JOIN m ON c.tool = m.tool")
def q_missed(spark, sf_dir):
    """A tool may be on one side alone."""
    cache, late = _cache(spark, sf_dir)
    return T.cache_status(cache.where("tool <> 'error'"), late.where("tool <> 'view'"))


@query(f"""WITH {CALLS}, f AS (SELECT trial, seq % 11 = 0 AS bad, seq % 11 <> 0 AND tool = 'error' AND seq % 3 = 0 AS boom, early AS hit, CASE WHEN seq % 5 > 0 THEN tool = 'error' END AS err FROM cal)
SELECT trial, count(*) AS executed, CAST(sum(CASE WHEN NOT bad AND NOT boom AND hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN boom OR NOT bad AND NOT hit THEN 1 ELSE 0 END) AS BIGINT) AS misses,
  CAST(sum(CASE WHEN bad OR boom OR coalesce(err, false) THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM f GROUP BY trial""")
def q_counters(spark, sf_dir):
    """What failed is a miss and an error, what can't be read an error alone."""
    c, error = calls(spark, sf_dir), F.col("tool") == "error"
    flags = c.select("trial", (F.col("seq") % 11 == 0).alias("malformed"), (error & (F.col("seq") % 3 == 0)).alias("failed"), F.col("early").alias("hit"), F.when(F.col("seq") % 5 > 0, error).alias("has_error"))
    return T.call_counters(flags, "trial")


@query(_CACHE + " SELECT tool, seq FROM late WHERE NOT EXISTS (SELECT 1 FROM cache WHERE cache.tool = late.tool AND cache.cache_key = late.cache_key AND cache.tool <> 'click')")
def q_uncovered(spark, sf_dir):
    """T12."""
    cache, late = _cache(spark, sf_dir)
    return T.uncovered(late, cache.where("tool <> 'click'")).select("tool", "seq")


@query("SELECT event_type AS tool, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase', 'other') GROUP BY event_type")
def q_semi(spark, sf_dir):
    """A whitelist of tools."""
    names = spark.createDataFrame([("view",), ("purchase",), ("other",)], "tool string")
    return calls(spark, sf_dir).join(names, "tool", "left_semi").groupBy("tool").agg(F.count("*").alias("n"))


_ARGUMENTS = (
    ("maps_geo", '{"address":"x"}', None), ("maps_geo", '{"address":" "}', "filled:address"), ("maps_geo", '{"address":1}', "wrong_type"), ("maps_geo", "{}", "missing_argument"),
    ("maps_geo", '{"address":"x","zip":1}', "unknown_argument"), ("maps_geo", '["x"]', "not_an_object"), ("maps_geo", '{"address":', "bad_json"),
    ("maps_weather", '{"location":"NATION_1","date":"2025-02-28","days":4}', None), ("maps_weather", '{"location":"NATION_1","date":"2025-02-30"}', "date:date"),
    ("maps_weather", '{"location":"Nowhere","date":"2025-02-28"}', "city:location"), ("maps_weather", '{"location":"NATION_1","date":"2025-02-28","days":5}', "range:days"),
    ("travel_search_trains", '{"origin":"NATION_1","destination":"NATION_2","date":"2025-01-01","depart_time_start":"10:00","depart_time_end":"09:00"}', "ordered:depart_time_start"),
    ("travel_search_trains", '{"origin":"NATION_1","destination":"NATION_2","date":"2025-01-01","train_type_filter":"fast"}', "one_of:train_type_filter"),
    ("travel_search_flights", '{"origin":"NATION_1","destination":"NATION_2","date":"2025-01-01","depart_time_end":"24:00"}', "clock:depart_time_end"),
    ("web_search", '{"query":null}', "wrong_type"), ("search_poi", '{"keywords":"x","city":"NATION_1","page_size":21}', "range:page_size"),
    ("search_poi", '{"keywords":"x","city":"NATION_1","price_min":5,"price_max":4}', "ordered:price_min"), ("search_poi", '{"keywords":"x","city":"NATION_1","location":"190.5,3"}', "place:location"),
    ("search_poi", '{"keywords":"x","city":"NATION_1","radius_km":null,"location":"120.5, 30"}', None), ("get_poi_detail", '{"id":"7"}', None),
    ("plan_route", '{"origin":"a","destination":"b","mode":"transit"}', "needs:mode"), ("plan_route", '{"origin":"a","destination":"b","mode":"transit","city":"NATION_2"}', None),
    ("compare_routes", '{"origin":"120.1,30.2,1","destination":"b"}', "place:origin"), ("search_along_route", '{"origin":"a","destination":"b","keywords":"x","mode":"driving","route_range":3001}', "range:route_range"),
)


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'"


@query("WITH c(k, code) AS (VALUES " + ", ".join(f"({i}, {_value(c)})" for i, (_, _, c) in enumerate(_ARGUMENTS)) + f") SELECT event_id AS seq, code IS NULL AS ok, code FROM events JOIN c ON event_id % {len(_ARGUMENTS)} = k")
def q_validate(spark, sf_dir):
    """Every call gets one of the argument texts above; nations are the known places."""
    pick = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in _ARGUMENTS]), (F.col("seq") % len(_ARGUMENTS) + 1).cast("int"))
    given = calls(spark, sf_dir).select("seq", pick(0).alias("tool"), pick(1).alias("arguments"))
    return T.validate_calls(given, "seq", table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


_MEAN = """m AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"""


def _store(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("tool"), F.col("vec_id").alias("example"), F.col("embedding").alias("evec"))
    each = e.select("tool", F.posexplode("evec").alias("i", "x")).groupBy("tool", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy("tool").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qvec"))
    return e, mean.withColumn("query", F.col("tool"))


@query(f"WITH {_MEAN}, s AS (SELECT m.label, vec_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS s FROM m JOIN embeddings e ON m.label = e.label) SELECT CAST(label AS VARCHAR) AS tool, vec_id AS example, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 8")
def q_topk(spark, sf_dir):
    """The examples nearest to each label's mean."""
    e, mean = _store(spark, sf_dir)
    return T.nearest(mean, e).select("tool", "example", "rank")


@query("SELECT CAST(label AS VARCHAR) AS tool, vec_id AS example, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), 'seed'))) AS rank FROM embeddings) WHERE rank <= 8")
def q_sample(spark, sf_dir):
    """T11."""
    return T.sample_examples(_store(spark, sf_dir)[0], fixed.EXAMPLES_PER_MISS, "seed")


@query("SELECT CAST(label AS VARCHAR) AS tool, count(*) AS n, CAST(max(len(embedding)) AS INT) AS dims FROM embeddings GROUP BY label")
def q_embstats(spark, sf_dir):
    """A17, S7."""
    return _store(spark, sf_dir)[0].groupBy("tool").agg(F.count("*").alias("n"), F.max(F.size("evec")).alias("dims"))
