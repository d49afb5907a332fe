"""Queries of the lookup and scoring families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripfold.functions import fixed, ratings, text
from tripfold.operators import lookups as L
from tripfold.operators import scoring as S
from tripfold.plans.adapters import ACTIVITIES, activities, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_POI = """poi AS (SELECT p_brand AS city, p_name AS name, min(p_partkey) AS ord FROM part GROUP BY ALL),
asked AS (SELECT DISTINCT p_brand AS city, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) ELSE right(p_name, 1) END AS place FROM part)"""


def _poi(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = F.col("p_partkey") % 3
    place = F.when(m == 0, F.col("p_name")).when(m == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.right("p_name", F.lit(1)))
    stored = p.groupBy(F.col("p_brand").alias("city"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return stored, p.select(F.col("p_brand").alias("city"), place.alias("place"))


@query(f"""WITH {_POI}, c AS (SELECT asked.city, place, name, ord, row_number() OVER (PARTITION BY asked.city, place ORDER BY name <> place, length(name), ord) AS n
FROM asked JOIN poi ON poi.city = asked.city AND contains(name, place) WHERE place <> '') SELECT city, place, name AS matched, ord FROM c WHERE n = 1""")
def q_substr(spark, sf_dir):
    """Whole names, words and single characters, by city."""
    poi, asked = _poi(spark, sf_dir)
    return L.match_places(asked, poi)


_KINDS = "CASE p_size % 3 WHEN 0 THEN 'hotels' WHEN 1 THEN 'attractions' ELSE 'food' END"
_CATS = ("舒适型", "滑雪", "食堂", "", "古镇")


@query(f"""WITH c AS (SELECT p_partkey, {_KINDS} AS kind, list_extract({list(_CATS)}, p_size % 5 + 1) AS cat FROM part)
SELECT p_partkey, kind, CASE WHEN kind = 'hotels' THEN CASE WHEN cat IN {fixed.HOTEL_CATEGORIES} THEN cat ELSE '商务酒店' END
  WHEN kind = 'attractions' THEN CASE WHEN cat = '' OR cat IN {fixed.EXCLUDED_CATEGORIES['attractions']} THEN '公园' ELSE cat END
  ELSE CASE WHEN cat = '' OR cat IN {fixed.EXCLUDED_CATEGORIES['food']} THEN '中餐' ELSE cat END END AS category FROM c""")
def q_category(spark, sf_dir):
    """Categories by rule."""
    m = F.col("p_size") % 3
    kind = F.when(m == 0, "hotels").when(m == 1, "attractions").otherwise("food")
    cat = F.element_at(F.array(*map(F.lit, _CATS)), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), L.place_category(kind, cat).alias("category"))


@query("SELECT p_name AS name, arg_min(p_brand, p_partkey) AS value FROM part GROUP BY p_name")
def q_firstwins(spark, sf_dir):
    """J3."""
    return L.first_stored(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), "name", "p_partkey", F.col("p_brand"))


_CITIES = (("西安市", "西安"), ("市", "市"), ("恩施自治州", "恩施"), ("大兴安岭地区", "大兴安岭地"), ("海淀区", "海淀"), ("香港", "香港"))


@query("WITH c(k, city) AS (VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_CITIES)) + ") SELECT s_suppkey, city FROM supplier JOIN c ON s_suppkey % 6 = k")
def q_citykey(spark, sf_dir):
    """J19."""
    name = F.element_at(F.array(*[F.lit(a) for a, _ in _CITIES]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.city_key(name).alias("city"))


_RULES = (  # place, season, weekdays, windows
    ("L0", 0, "11-01", "03-31", (1, 2, 3, 4, 5), (("08:00", "18:00"),)),
    ("L0", 1, "01-01", "12-31", (1, 2, 3, 4, 5, 6, 7), (("09:00", "12:00"), ("13:00", "20:00"))),
    ("L1", 0, "04-01", "10-31", (6, 7), (("10:00", "22:00"),)),
    ("L2", 0, "01-01", "12-31", (1, 2, 3, 4, 5, 6, 7), ()),
    ("L2", 1, "01-01", "12-31", (2, 3, 4, 5, 6, 7), (("08:30", "17:00"),)),
)


def _sql_rules() -> str:
    row = lambda r: f"('{r[0]}', {r[1]}, '{r[2]}', '{r[3]}', {list(r[4])}, {[list(w) for w in r[5]] or '[]::VARCHAR[][]'})"
    return "rules(place, rule_ix, ss, se, weekdays, windows) AS (VALUES " + ", ".join(map(row, _RULES)) + ")"


@query(f"""WITH {ACTIVITIES}, {_sql_rules()}, v AS (SELECT ix AS visit, loc AS place, d, printf('%02d:%02d', st // 60, st % 60) AS s, printf('%02d:%02d', en // 60, en % 60) AS e FROM evt WHERE typ = 'attraction'),
h AS (SELECT visit, s, e, rule_ix, NOT list_contains(weekdays, isodow(d)) AS closed, windows FROM v JOIN rules ON rules.place = v.place
  WHERE CASE WHEN ss <= se THEN strftime(d, '%m-%d') BETWEEN ss AND se ELSE strftime(d, '%m-%d') >= ss OR strftime(d, '%m-%d') <= se END),
f AS (SELECT *, row_number() OVER (PARTITION BY visit ORDER BY rule_ix) AS n FROM h WHERE closed OR len(windows) > 0)
SELECT v.visit, CASE WHEN f.visit IS NOT NULL THEN NOT closed AND len(list_filter(windows, lambda w: f.s >= w[1] AND f.e <= w[2])) > 0 END AS open FROM v LEFT JOIN f ON f.visit = v.visit AND n = 1""")
def q_opening(spark, sf_dir):
    """A season over New Year, a weekday that closes, a rule without windows."""
    rows = [(p, i, a, b, list(w), [(o, c) for o, c in t]) for p, i, a, b, w, t in _RULES]
    rules = spark.createDataFrame(rows, "place string, rule_ix int, season_start string, season_end string, weekdays array<int>, windows array<struct<open: string, close: string>>")
    clock = lambda c: F.format_string("%02d:%02d", F.expr(f"{c} div 60").cast("int"), (F.col(c) % 60).cast("int"))
    v = activities(spark, sf_dir).where("typ = 'attraction'").select(F.col("ix").alias("visit"), F.col("loc").alias("place"), "d", clock("st").alias("s"), clock("en").alias("e"))
    return L.within_opening(v, rules).select("visit", "open")


_ADMIN = """admin AS (SELECT r_name AS name, printf('%02d0000', r_regionkey + 10) AS code, r_name AS full_name FROM region
  UNION ALL SELECT n_name, printf('%02d%02d00', n_regionkey + 10, n_nationkey + 1), concat(r_name, n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('D', CAST(s_suppkey % 7 AS VARCHAR)), printf('%02d%02d%02d', n_regionkey + 10, n_nationkey + 1, s_suppkey % 7 + 1), concat(r_name, n_name, 'D', CAST(s_suppkey % 7 AS VARCHAR))
    FROM (SELECT DISTINCT s_nationkey, s_suppkey % 7 AS s_suppkey FROM supplier) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _admin(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    region = (F.col("n_regionkey") + 10).cast("string")
    a = r.select(F.col("r_name").alias("name"), F.concat((F.col("r_regionkey") + 10).cast("string"), F.lit("0000")).alias("code"))
    b = n.select(F.col("n_name").alias("name"), F.concat(region, two(F.col("n_nationkey") + 1), F.lit("00")).alias("code"))
    k = F.col("s_suppkey") % 7
    c = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("D"), k.cast("string")).alias("name"), F.concat(region, two(F.col("n_nationkey") + 1), two(k + 1)).alias("code")).distinct()
    return L.full_names(a.unionByName(b).unionByName(c))


@query(f"WITH {_ADMIN} SELECT name, code, full_name FROM admin")
def q_hier(spark, sf_dir):
    """Three levels."""
    return _admin(spark, sf_dir)


@query(f"""WITH {_ADMIN}, asked AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN concat('D', CAST(c_custkey % 7 AS VARCHAR)) WHEN 2 THEN concat(n_name, 'D', CAST(c_custkey % 7 AS VARCHAR)) ELSE 'Nowhere' END AS asked
  FROM customer JOIN nation ON c_nationkey = n_nationkey), h AS (SELECT asked, code, full_name FROM asked JOIN admin ON suffix(full_name, asked)),
g AS (SELECT asked, min(CASE WHEN full_name = asked THEN code END) AS x, count(DISTINCT code) AS n, min(code) AS c FROM h GROUP BY asked)
SELECT asked.asked, coalesce(x, CASE WHEN n = 1 THEN c END) AS code, CASE WHEN x IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM asked LEFT JOIN g ON g.asked = asked.asked""")
def q_suffix(spark, sf_dir):
    """J16."""
    d, m = F.concat(F.lit("D"), (F.col("c_custkey") % 7).cast("string")), F.col("c_custkey") % 4
    names = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = F.when(m == 0, F.col("n_name")).when(m == 1, d).when(m == 2, F.concat("n_name", d)).otherwise("Nowhere")
    return L.resolve_names(names.select(asked.alias("asked")), _admin(spark, sf_dir))


@query("""WITH a AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN left(n_name, length(n_name) - 1) ELSE concat(c_name, '?') END AS asked FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT asked FROM a WHERE EXISTS (SELECT 1 FROM nation WHERE n_name IN (asked, concat(asked, '1'), concat(asked, '2')))""")
def q_known(spark, sf_dir):
    """customers' names of nations, some of which lack one of the suffixes that are tried."""
    m = F.col("c_custkey") % 3
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    asked = F.when(m == 0, F.col("name")).when(m == 1, F.expr("left(name, length(name) - 1)")).otherwise(F.concat("c_name", F.lit("?")))
    names = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(asked.alias("asked"))
    return L.known_names(names, n, ("", "1", "2"))


_TERMINAL = """whole AS (SELECT concat(r_name, '省') AS full_name FROM region UNION SELECT concat(r_name, '省', n_name, '市') FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT concat(r_name, '省', n_name, '市', 'D', CAST(s_suppkey % 7 AS VARCHAR), '区') FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
asked AS (SELECT DISTINCT CASE c_custkey % 8 WHEN 0 THEN concat(n_name, '市') WHEN 1 THEN n_name WHEN 2 THEN concat(' D', CAST(c_custkey % 9 AS VARCHAR), '区') WHEN 3 THEN concat(n_name, '市D1区') WHEN 4 THEN concat(n_name, '市x') WHEN 5 THEN '  '
  WHEN 6 THEN c_name ELSE concat('D', CAST(c_custkey % 9 AS VARCHAR)) END AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_TERMINAL}, t AS (SELECT asked, trim(asked) AS name FROM asked), s(x) AS (VALUES ('省'), ('市'), ('区'), ('县'), ('旗'), ('盟'), ('州'), ('地区'), ('林区'), ('特区')),
k AS (SELECT asked, name, CASE WHEN name = '' THEN 'blank' WHEN (SELECT count(*) FROM s WHERE contains(name, x)) > 1 THEN 'levels' WHEN EXISTS (SELECT 1 FROM s WHERE contains(name, x) AND NOT ends_with(name, x)) THEN 'compound' END AS shape FROM t),
p AS (SELECT asked, count(*) AS n, arg_min(full_name, (length(full_name), full_name)) AS f FROM k JOIN whole ON ends_with(full_name, name) WHERE shape IS NULL GROUP BY asked),
q AS (SELECT asked, count(*) AS n, arg_min(full_name, (length(full_name), full_name)) AS f FROM k, s JOIN whole ON ends_with(full_name, concat(name, x)) WHERE shape IS NULL GROUP BY asked)
SELECT k.asked, shape IS NULL AND coalesce(p.n, q.n) IS NOT NULL AS valid, coalesce(shape, CASE WHEN coalesce(p.n, q.n) IS NOT NULL THEN 'ok' ELSE 'unknown' END) AS reason, coalesce(p.n, q.n, 0) AS n, coalesce(p.f, q.f) AS first FROM k LEFT JOIN p ON p.asked = k.asked LEFT JOIN q ON q.asked = k.asked""")
def q_terminal(spark, sf_dir):
    """Whole names, short ones, several levels, text behind a suffix, blanks and unknown names, with the reason."""
    n, r, s, c = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    province, city = F.concat("r_name", F.lit("省")), F.concat("r_name", F.lit("省"), "n_name", F.lit("市"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(city, F.lit("D"), (F.col("s_suppkey") % 7).cast("string"), F.lit("区"))
    full = r.select(province.alias("full_name")).unionByName(both.select(city.alias("full_name"))).unionByName(s.join(both, F.col("s_nationkey") == F.col("n_nationkey")).select(part.alias("full_name"))).distinct()
    m, d = F.col("c_custkey") % 8, (F.col("c_custkey") % 9).cast("string")
    asked = (
        F.when(m == 0, F.concat("n_name", F.lit("市"))).when(m == 1, F.col("n_name")).when(m == 2, F.concat(F.lit(" D"), d, F.lit("区"))).when(m == 3, F.concat("n_name", F.lit("市D1区")))
        .when(m == 4, F.concat("n_name", F.lit("市x"))).when(m == 5, "  ").when(m == 6, F.col("c_name")).otherwise(F.concat(F.lit("D"), d))
    )
    return L.terminal_names(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(asked.alias("asked")), full)


@query(f"""WITH {_ADMIN}, more AS (SELECT full_name, code FROM admin UNION ALL SELECT full_name, concat('9', substr(code, 2)) FROM admin WHERE substr(code, 6, 1) = '1')
SELECT full_name, count(DISTINCT code) AS codes FROM more GROUP BY full_name HAVING count(DISTINCT code) > 1""")
def q_conflicts(spark, sf_dir):
    """Full names with two codes."""
    a = _admin(spark, sf_dir)
    return L.conflicting_names(a.unionByName(a.where("substr(code, 6, 1) = '1'").withColumn("code", F.expr("concat('9', substr(code, 2))"))))


_NESTED = "(SELECT o_custkey AS trial, o_orderkey, CAST(o_orderdate AS DATE) AS date, l_linenumber, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"SELECT trial, o_orderkey, date, CAST(l_linenumber AS INT) AS line, l_suppkey AS act FROM {_NESTED}")
def q_flatten(spark, sf_dir):
    """Lines nested by order and customer, and flattened again."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    acts = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("activities"))
    day = F.struct(F.to_date("o_orderdate").alias("date"), F.array(F.struct(F.col("o_orderkey").alias("city"), "activities")).alias("segments"))
    plans = o.join(acts, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("trial")).agg(F.collect_list(day).alias("days"))
    return S.flattened(plans, "days").select("trial", F.col("city").alias("o_orderkey"), "date", F.col("act.l_linenumber").cast("int").alias("line"), F.col("act.l_suppkey").alias("act"))


@query("SELECT c_custkey AS person, path, value FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS a, c_nationkey % 5 AS b, c_mktsegment AS c FROM customer), LATERAL (VALUES ('avg_budget', CAST(a AS VARCHAR)), ('intensity.max_poi_per_day', CAST(b AS VARCHAR)), ('transport.must', c)) t(path, value) WHERE value <> '0'")
def q_unpivot(spark, sf_dir):
    """A customer's columns as preference leaves; a 0 is none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.floor("c_acctbal").cast("string").alias("a"), (F.col("c_nationkey") % 5).cast("string").alias("b"), F.col("c_mktsegment").alias("c"))
    return c.select("person", F.expr("stack(3, 'avg_budget', a, 'intensity.max_poi_per_day', b, 'transport.must', c) as (path, value)")).where("value <> '0'")


@query(f"""WITH {ACTIVITIES}, w AS (SELECT usr AS person, 'must' AS kind, concat('L', CAST(usr % 20 AS VARCHAR)) AS item FROM evt UNION SELECT usr, 'reject', concat('1', CAST(usr % 10 AS VARCHAR)) FROM evt)
SELECT DISTINCT person, kind, item, CASE kind WHEN 'must' THEN 2 ELSE -2 END AS score FROM w WHERE EXISTS (SELECT 1 FROM evt WHERE usr = person AND typ = 'attraction' AND contains(loc, item))""")
def q_must(spark, sf_dir):
    """Each person wants one place and refuses part of a name."""
    a = activities(spark, sf_dir)
    u = a.select(F.col("usr").alias("person")).distinct()
    wishes = u.select("person", F.lit("must").alias("kind"), F.concat(F.lit("L"), (F.col("person") % 20).cast("string")).alias("item"))
    wishes = wishes.unionByName(u.select("person", F.lit("reject").alias("kind"), F.concat(F.lit("1"), (F.col("person") % 10).cast("string")).alias("item")))
    return S.must_scores(a.where("typ = 'attraction'").select(F.col("usr").alias("person"), F.col("loc").alias("place")), wishes)


@query(f"""WITH {ACTIVITIES} SELECT ix, CASE WHEN m OR r THEN (CASE WHEN m THEN 2 ELSE 0 END) - (CASE WHEN r THEN 2 ELSE 0 END) WHEN p THEN 1 WHEN v THEN -1 ELSE 0 END AS trip,
  CASE WHEN h THEN CASE WHEN p THEN 1 WHEN v THEN -1 ELSE 0 END END AS hotel
FROM (SELECT ix, loc IN ('L1', 'L2', 'L3') AS m, loc IN ('L3', 'L4') AS r, loc IN ('L1', 'L5') AS p, loc IN ('L5', 'L6') AS v, usr % 2 = 0 AS h FROM evt)""")
def q_tier(spark, sf_dir):
    """U3 to U5."""
    names = lambda *x: F.array(*[F.lit(f"L{i}") for i in x])
    even, none = F.col("usr") % 2 == 0, F.array().cast("array<string>")
    hotel = S.first_tier(F.col("loc"), F.when(even, names(1, 5)).otherwise(none), F.when(even, names(5, 6)))
    return activities(spark, sf_dir).select("ix", S.tier(F.col("loc"), names(1, 2, 3), names(3, 4), names(1, 5), names(5, 6)).alias("trip"), hotel.alias("hotel"))


_LISTS = """p AS (SELECT o_custkey AS person, list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE month(o_orderdate) <= 6) AS a, list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE month(o_orderdate) > 6) AS r FROM orders GROUP BY o_custkey),
m AS (SELECT person, len(list_filter(r, lambda x: list_contains(coalesce(a, []), x))) AS collected, len(r) AS possible, len(list_filter(coalesce(a, []), lambda x: list_contains(r, x))) AS correct, len(coalesce(a, [])) AS agent_total,
  len(list_filter(list_distinct(r), lambda x: NOT list_contains(coalesce(a, []), x))) AS missed, len(list_filter(list_distinct(coalesce(a, [])), lambda x: NOT list_contains(r, x))) AS spurious FROM p WHERE len(r) > 0)"""


def _matches(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    half = lambda c: F.collect_list(F.when(c, F.col("o_orderpriority")))
    p = o.groupBy(F.col("o_custkey").alias("person")).agg(half(F.month("o_orderdate") <= 6).alias("a"), half(F.month("o_orderdate") > 6).alias("r"))
    return S.compare_lists(p, "a", "r")


@query(f"WITH {_LISTS} SELECT person, CAST(collected AS INT) AS collected, CAST(possible AS INT) AS possible, CAST(correct AS INT) AS correct, CAST(agent_total AS INT) AS agent_total, CAST(missed AS INT) AS missed, CAST(spurious AS INT) AS spurious FROM m")
def q_listpr(spark, sf_dir):
    """A customer's priorities in one half of the year against the other's."""
    return _matches(spark, sf_dir).drop("a", "r")


@query(f"""WITH {_LISTS}, s AS (SELECT person, collected / possible::DOUBLE AS recall, CASE WHEN agent_total = 0 THEN 1.0::DOUBLE ELSE correct / agent_total::DOUBLE END AS precision FROM m)
SELECT person, recall, precision, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s""")
def q_prf(spark, sf_dir):
    """E4."""
    return S.prf(_matches(spark, sf_dir), "person")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_nationkey = c_custkey % 25 THEN 1 WHEN c_custkey % 3 = 0 AND c_nationkey = 0 THEN 1 ELSE 0 END AS collected FROM customer WHERE c_nationkey <> 0")
def q_scalar(spark, sf_dir):
    """Every third customer has no report, which counts as 0."""
    c = table(spark, sf_dir, "customer").withColumn("a", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 25))
    return S.compare_scalars(c, "a", "c_nationkey").select("c_custkey", "collected")


@query("""WITH u AS (SELECT c_nationkey AS trial, c_mktsegment AS person, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2)) - 4500) AS DOUBLE) AS score FROM customer GROUP BY ALL),
g AS (SELECT trial, min(score) AS low, max(score) AS high FROM u GROUP BY trial)
SELECT trial, low, high, CASE WHEN low = high THEN 100.0::DOUBLE WHEN high > 0 AND low >= 0 THEN low / high * 100 WHEN high > 0 THEN 0.0 WHEN low = 0 THEN 0.0 ELSE high / low * 100 END AS fairness FROM g""")
def q_fairness(spark, sf_dir):
    """A nation is a trial, a market segment a person; balances less 4500, so some are below 0."""
    u = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("trial"), "c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)") - 4500).cast("double").alias("score"))
    return S.fairness(u, "trial", "score")


_WORDS = tuple(fixed.RATINGS)


@query("SELECT doc_id, CAST((doc_id % 5) + 1 AS INT) AS raw, ((doc_id % 5) + 1 - 1) / 4.0::DOUBLE * 100.0 AS norm, CASE WHEN toxic = 1 THEN ((doc_id % 5) + 1 - 1) / 4.0::DOUBLE * 100.0 * (3 / 5.0::DOUBLE) ELSE ((doc_id % 5) + 1 - 1) / 4.0::DOUBLE * 100.0 END AS final FROM labels")
def q_rating(spark, sf_dir):
    """Rating words with and without their prefix, normalised, and scaled by a meta score where there is one."""
    i = (F.col("doc_id") % 5 + 1).cast("int")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), i)
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(fixed.RATING_PREFIXES[0]), F.lit(" "), word)).otherwise(F.concat(word, F.lit("。")))
    rows = table(spark, sf_dir, "labels").select("doc_id", ratings.rating_score(said).alias("raw"), F.when(F.col("toxic") == 1, F.lit(3)).alias("meta"))
    norm = ratings.normalise("raw")
    return rows.select("doc_id", "raw", norm.alias("norm"), ratings.meta_weighted(norm, "meta").alias("final"))


@query(f"""SELECT doc_id, dim, CASE WHEN doc_id % 3 = 2 AND dim = 'plan_humanization' THEN NULL ELSE 'a < b' END AS reasoning,
  CASE WHEN doc_id % 3 = 2 AND dim = 'plan_humanization' THEN NULL ELSE CAST(quality + 4 AS VARCHAR) END AS rating FROM labels, (VALUES ('interaction_quality'), ('plan_humanization')) t(dim)""")
def q_tags(spark, sf_dir):
    """Responses with comments, fences, spaces within tags, bare brackets and a missing dimension."""
    dims = (fixed.JUDGE_DIMENSIONS[2], fixed.JUDGE_DIMENSIONS[4])
    one = lambda d: F.concat(F.lit(f"< {d} ><!-- <rating>0</rating> --><reasoning>a < b</reasoning><rating> "), (F.col("quality") + 4).cast("string"), F.lit(f"</rating></{d} >"))
    m = F.col("doc_id") % 3
    body = F.when(m == 2, one(dims[0])).otherwise(F.concat(one(dims[0]), one(dims[1])))
    said = F.when(m == 0, F.concat(F.lit("```xml\n<response>"), body, F.lit("</response>\n```"))).otherwise(body)
    return S.judge_fields(table(spark, sf_dir, "labels").withColumn("response", said), "doc_id", "response", dims)


_BROKEN = ("<response><interaction_quality><reasoning>r1</reasoning><rating>5</rating><plan_humanization><reasoning>r2 &lt; &amp;</reasoning><rating>4</rating></plan_humanization></response>",
           "<interaction_quality><reasoning>r1<rating>5</rating></interaction_quality><plan_human><reasoning>r2 < &</reasoning><rating>4</plan_human>",
           "<plan_humanization_score><reasoning>r2 < &</reasoning>4</plan_humanization_score><interaction><reasoning>r1 <b>x</b></reasoning><rating>5",
           "```\n<meta_evaluation><reasoning> m </reasoning><rating>3</rating></meta_evaluation>\n```")


@query("""SELECT doc_id, dim, CASE WHEN dim = 'meta_evaluation' THEN CASE WHEN k = 3 THEN 'm' END WHEN k = 3 THEN NULL WHEN dim = 'interaction_quality' THEN CASE k WHEN 2 THEN 'r1 <b>x</b>' ELSE 'r1' END ELSE 'r2 < &' END AS reasoning,
  CASE WHEN dim = 'meta_evaluation' THEN CASE WHEN k = 3 THEN '3' END WHEN k = 3 THEN NULL WHEN dim = 'interaction_quality' THEN '5' WHEN k < 2 THEN '4' END AS rating
FROM (SELECT doc_id, doc_id % 4 AS k FROM labels), (VALUES ('interaction_quality'), ('plan_humanization'), ('meta_evaluation')) t(dim)""")
def q_repair(spark, sf_dir):
    """Near names of tags, missing closers and ratings, entities, and the meta judge's tag."""
    said = F.element_at(F.array(*map(F.lit, _BROKEN)), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.judge_fields(table(spark, sf_dir, "labels").withColumn("response", said), "doc_id", "response", (fixed.JUDGE_DIMENSIONS[2], fixed.JUDGE_DIMENSIONS[4], "meta_evaluation"))


@query("SELECT CAST(toxic AS VARCHAR) AS dim, CAST(sum(v) AS DOUBLE) / count(v) AS mean, min(v) AS lo, max(v) AS hi, count(v) AS n FROM (SELECT toxic, CAST(CASE WHEN doc_id % 4 > 0 THEN doc_id % 5 + 1 END AS INT) AS v FROM labels) GROUP BY toxic")
def q_dimstats(spark, sf_dir):
    """Every fourth score is missing."""
    v = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 5 + 1).cast("int")
    return S.dimension_stats(table(spark, sf_dir, "labels").select(F.col("toxic").cast("string").alias("dim"), v.alias("v")), "dim", "v")


@query("SELECT range AS score, (SELECT count(*) FROM labels WHERE 2 * quality + toxic + 1 = range) AS n FROM range(1, 6)")
def q_dist(spark, sf_dir):
    """A10: no row has the score 5."""
    from tripfold.operators.rollup import distribution

    return distribution(table(spark, sf_dir, "labels").withColumn("s", 2 * F.col("quality") + F.col("toxic") + 1), "s")


@query(f"""WITH {ACTIVITIES}, v AS (SELECT ix AS visit, usr AS person, loc, CASE usr % 3 WHEN 0 THEN NULL WHEN 1 THEN 'park' ELSE 'museum' END AS cat FROM evt WHERE typ = 'attraction')
SELECT * FROM (SELECT visit, person, CASE WHEN contains(loc, '7') THEN 1 WHEN contains(loc, '8') THEN -1 WHEN cat = 'museum' THEN 1 WHEN cat = 'park' AND person % 2 = 0 THEN -1 END AS score FROM v WHERE cat IS NOT NULL) WHERE score IS NOT NULL""")
def q_catscore(spark, sf_dir):
    """U2."""
    m = F.col("usr") % 3
    v = activities(spark, sf_dir).where("typ = 'attraction'").select(F.col("ix").alias("visit"), F.col("usr").alias("person"), F.col("loc").alias("place"), F.when(m == 1, "park").when(m == 2, "museum").alias("category"))
    text_ = lambda *x: F.array(*map(F.lit, x))
    wishes = v.select("person").distinct().select("person", text_("7", "museum").alias("positive"), F.when(F.col("person") % 2 == 0, text_("8", "park")).otherwise(text_("8")).alias("negative"))
    return S.category_scores(v, wishes)


_DIMENSION = "CASE typ WHEN 'attraction' THEN 'attraction' WHEN 'food' THEN 'food' WHEN 'hotel' THEN 'hotel' WHEN 'intracity_transport' THEN 'transport' ELSE 'budget' END"


@query(f"""WITH {ACTIVITIES}, i AS (SELECT d AS trial, usr, {_DIMENSION} AS dim, CASE ix % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE -2 END AS s FROM evt), n AS (SELECT trial, count(DISTINCT usr) AS people FROM i GROUP BY trial),
p AS (SELECT d AS trial, count(*) AS penalty FROM evt WHERE typ = 'rest' AND ix % 5 = 0 GROUP BY d),
t AS (SELECT n.trial, people, {', '.join(f"CAST(coalesce((SELECT sum(s) FROM i WHERE i.trial = n.trial AND dim = '{x}'), 0) AS BIGINT) AS {x}" for x in S.DIMENSIONS)}, coalesce(penalty, 0) AS penalty FROM n LEFT JOIN p ON p.trial = n.trial)
SELECT *, {' + '.join(S.DIMENSIONS)} - penalty AS total, CAST({' + '.join(S.DIMENSIONS)} - penalty AS DOUBLE) / people AS utility FROM t""")
def q_utility(spark, sf_dir):
    """A day is a trial; scores by rule."""
    a = activities(spark, sf_dir)
    kind = F.when(F.col("typ").isin("attraction", "food", "hotel"), F.col("typ")).when(F.col("typ") == "intracity_transport", "transport").otherwise("budget")
    m = F.col("ix") % 4
    items = a.select(F.col("d").alias("trial"), F.col("usr").alias("person"), kind.alias("dimension"), F.when(m == 0, 2).when(m == 1, 1).when(m == 2, -1).otherwise(-2).alias("score"))
    lost = a.where("typ = 'rest' and ix % 5 = 0").select(F.col("d").alias("trial"), F.lit(1).alias("penalty"))
    return S.utility(items, lost, items.select("trial", "person").distinct())
