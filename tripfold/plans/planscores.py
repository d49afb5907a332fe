"""Queries that score the plans of planned.py by wishes that customers give, with parts as the catalogue of places."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed
from tripfold.operators import plan_scores as S
from tripfold.operators import plans as P
from tripfold.plans.adapters import table
from tripfold.plans.planned import _FLAT, Planned
from tripfold.session import written

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_POI = {
    "city": "concat('C', CAST(p_partkey % 4 AS STRING), CASE WHEN p_size % 2 = 0 THEN '市' ELSE '' END)", "name": "concat('L', CAST(p_partkey % 5 AS STRING), CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END)",
    "ord": "p_partkey", "poi_type": "CASE p_partkey % 3 WHEN 0 THEN 'hotels' WHEN 1 THEN 'attractions' ELSE 'food' END",
    "category": "CASE p_size % 5 WHEN 0 THEN '舒适型' WHEN 1 THEN '滑雪' WHEN 2 THEN '食堂' WHEN 3 THEN '' ELSE '古镇' END",
}
_OWN = "concat('C', CAST(c_custkey % 4 AS STRING))"
_L = lambda k: f"concat('L', CAST((c_custkey + {k}) % 5 AS STRING))"
_M = lambda k: f"concat('M', CAST((c_custkey + {k}) % 3 AS STRING))"


def _wishes() -> list[tuple]:
    """user, city, field, kind, ord and value of each wish, as expressions over a customer. U2 wishes nothing."""
    out = []
    for usr, city in (("U0", _OWN), ("U1", f"concat({_OWN}, '市')")):
        lists = {
            "attractions.must_visit": (_L(0), _L(1)), "attractions.reject_visit": (_L(2),), "attractions.category_pref.positive": ("'公园'", _L(3)), "attractions.category_pref.negative": ("'古镇'", _L(3)),
            "food.must_eat": ("'中餐'", "'L7'"), "food.reject_eat": ("'中餐'", _L(4)), "food.prefer_eat": ("'古镇'", _L(0)), "food.avoid_eat": ("'舒适型'", "'x'"),
        }
        out += [(usr, city, f, "list", k, v) for f, vs in lists.items() for k, v in enumerate(vs)]
        wide = {"transport.must": (_M(0),), "transport.reject": (_M(1), _M(0)) if usr == "U1" else (_M(1),), "transport.prefer": ("'M2'",), "transport.avoid": ("'M1'", "'M2'", "'M0'"), "hotel_preference.prefer": ("'商务酒店'",), "hotel_preference.avoid": ("'舒适型'", "'商务酒店'")}
        out += [(usr, None, f, "list", k, v) for f, vs in wide.items() for k, v in enumerate(vs) if not (f.startswith("hotel") and usr == "U1" and f.endswith("prefer"))]
        out += [(usr, None, "avg_budget", "scalar", 0, "CAST(c_custkey % 90 AS STRING)"), (usr, None, "intensity.max_poi_per_day", "scalar", 0, "CAST(c_custkey % 3 AS STRING)"), (usr, None, "intensity.max_active_hours", "scalar", 0, "CAST(c_custkey % 2 AS STRING)")]
    return out


class Scored(Planned):
    def __init__(self, spark, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.poi = table(spark, sf_dir, "part").where("p_partkey % 5 <> 4").selectExpr(*[f"{e} AS {n}" for n, e in _POI.items()])
        rows = ", ".join(f"struct('{u}' AS usr, {c or 'CAST(NULL AS STRING)'} AS city, '{f}' AS field, '{k}' AS kind, {o} AS ord, {v} AS value)" for u, c, f, k, o, v in _wishes())
        few = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a small table that unfolds to a large one
        self._wishes = few.selectExpr("c_custkey AS trial", f"inline(array({rows}))")
        self.taking = S.activity_users(self.acts, self.users)

    @cached_property
    def wishes(self) -> DataFrame:
        return written(self._wishes)  # each score takes some of them

    @cached_property
    def known(self) -> DataFrame:
        return written(S.categories(self.acts.withColumn("location", F.coalesce("location", F.lit(""))), self.poi))  # so that Spark knows which side of its joins is the small one

    def clean(self) -> DataFrame:
        return S.scorable(self.acts, self.users)

    def scores(self) -> DataFrame:
        return S.all_scores(self.segments, self.acts, self.users, self.wishes, self.poi)


_HOTELS = ", ".join(f"'{c}'" for c in fixed.HOTEL_CATEGORIES)
_BAD = {k: ", ".join(f"'{c}'" for c in v) for k, v in fixed.EXCLUDED_CATEGORIES.items()}
_CATEGORY = f"""CASE t WHEN 'hotels' THEN CASE WHEN c IN ({_HOTELS}) THEN c ELSE '商务酒店' END WHEN 'attractions' THEN CASE WHEN trim(c) = '' OR c IN ({_BAD["attractions"]}) THEN '公园' ELSE c END
  ELSE CASE WHEN trim(c) = '' OR c IN ({_BAD["food"]}) THEN '中餐' ELSE c END END"""
_WISHES = " UNION ALL ".join(f"SELECT c_custkey AS trial, '{u}' AS usr, {c or 'NULL'} AS city, '{f}' AS field, '{k}' AS kind, {o} AS ord, {v} AS value FROM customer" for u, c, f, k, o, v in _wishes())
_SCORES = (
    _FLAT
    + f""", wish AS ({_WISHES}),
poi AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _POI.items())} FROM part WHERE p_partkey % 5 <> 4),
au AS (SELECT trial, day_ix, day, seg_ix, act_ix, city, typ, coalesce(location, '') AS location, coalesce(location, too) AS place, st, en, cost, usr FROM act JOIN usr USING (trial)
  WHERE who IN (0, 1, 2, 5) OR who IN (3, 6) AND usr = 'U0' OR who = 4 AND usr <> 'U0'),
tm AS (SELECT * FROM au WHERE typ <> 'hotel' AND en > st),
bad AS (SELECT DISTINCT a.trial, a.day, a.place, a.st FROM tm a JOIN tm b ON a.trial = b.trial AND a.day_ix = b.day_ix AND a.seg_ix = b.seg_ix AND a.usr = b.usr AND a.act_ix <> b.act_ix AND a.st < b.en AND b.st < a.en),
clean AS (SELECT * FROM au WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.trial = au.trial AND bad.day = au.day AND bad.place IS NOT DISTINCT FROM au.place AND bad.st = au.st)),
asked AS (SELECT DISTINCT city, location FROM act WHERE location <> ''),
mt AS (SELECT asked.city, location, name, row_number() OVER (PARTITION BY asked.city, location ORDER BY name <> location, length(name), ord) AS n FROM asked JOIN poi ON poi.city = asked.city AND contains(name, location)),
dt AS (SELECT city, name, arg_max(poi_type, ord) AS t, arg_max(category, ord) AS c FROM poi GROUP BY ALL),
res AS (SELECT mt.city, location, mt.name AS matched, t AS poi_type, {_CATEGORY} AS category FROM mt JOIN dt ON dt.city = mt.city AND dt.name = mt.name WHERE n = 1),
lst AS (SELECT trial, usr, coalesce(city, '') AS wc, field, list(value ORDER BY ord) AS xs FROM wish WHERE kind = 'list' GROUP BY ALL),
named AS (SELECT w.trial, w.usr, w.city, field, ord, value, location FROM clean JOIN wish w ON w.trial = clean.trial AND w.usr = clean.usr AND w.city = clean.city AND contains(location, value)
  WHERE typ = 'attraction' AND field IN ('attractions.must_visit', 'attractions.reject_visit')),
u1 AS (SELECT DISTINCT trial, usr, 'attraction' AS dimension, field, ord, value AS about, CASE WHEN field LIKE '%must%' THEN 2 ELSE -2 END AS score FROM named),
u2 AS (SELECT v.trial, v.usr, 'attraction' AS dimension, field, v.location AS about, CASE WHEN field LIKE '%positive' THEN 1 ELSE -1 END AS score FROM clean v JOIN res ON res.city = v.city AND res.location = v.location
  JOIN lst l ON l.trial = v.trial AND l.usr = v.usr AND wc = v.city WHERE typ = 'attraction' AND field LIKE '%category_pref%' AND (list_contains(xs, category) OR len(list_filter(xs, lambda x: contains(v.location, x))) > 0)
  AND NOT EXISTS (SELECT 1 FROM named n WHERE n.trial = v.trial AND n.usr = v.usr AND n.city = v.city AND n.location = v.location)),
ml AS (SELECT v.trial, v.usr, v.day_ix, v.seg_ix, v.act_ix, v.location, field, CASE field WHEN 'food.must_eat' THEN 1 WHEN 'food.reject_eat' THEN 2 WHEN 'food.prefer_eat' THEN 3 ELSE 4 END AS p,
  len(list_filter(xs, lambda x: contains(v.location, x))) > 0 AS byname, list_contains(xs, category) AS bycat FROM clean v JOIN res ON res.city = v.city AND res.location = v.location
  JOIN lst l ON l.trial = v.trial AND l.usr = v.usr AND wc = v.city WHERE typ = 'food' AND field LIKE 'food.%'),
mb AS (SELECT trial, usr, day_ix, seg_ix, act_ix, min(CASE WHEN byname THEN p END) AS pn, min(CASE WHEN bycat AND p < 3 THEN p END) AS ps, min(CASE WHEN bycat AND p > 2 THEN p END) AS pw FROM ml GROUP BY ALL),
u3 AS (SELECT trial, usr, 'food' AS dimension, field, location AS about, CASE p WHEN 1 THEN 2 WHEN 2 THEN -2 WHEN 3 THEN 1 ELSE -1 END AS score FROM ml JOIN mb USING (trial, usr, day_ix, seg_ix, act_ix)
  WHERE CASE WHEN pn IS NOT NULL THEN p = pn WHEN ps IS NOT NULL THEN bycat AND p < 3 ELSE coalesce(p = pw, false) END),
lg AS (SELECT seg.trial, usr, mode, max(CASE WHEN field = 'transport.must' AND list_contains(xs, mode) THEN 1 ELSE 0 END) AS a, max(CASE WHEN field = 'transport.reject' AND list_contains(xs, mode) THEN 1 ELSE 0 END) AS b,
  max(CASE WHEN field = 'transport.prefer' AND list_contains(xs, mode) THEN 1 ELSE 0 END) AS c, max(CASE WHEN field = 'transport.avoid' AND list_contains(xs, mode) THEN 1 ELSE 0 END) AS d
  FROM seg JOIN lst ON lst.trial = seg.trial WHERE leg AND mode <> '' AND wc = '' GROUP BY seg.trial, usr, mode, day_ix, seg_ix),
u4 AS (SELECT trial, usr, 'transport' AS dimension, 'transport.must' AS field, mode AS about, 2 AS score FROM lg WHERE a = 1 UNION ALL SELECT trial, usr, 'transport', 'transport.reject', mode, -2 FROM lg WHERE b = 1
  UNION ALL SELECT trial, usr, 'transport', 'transport.prefer', mode, 1 FROM lg WHERE a + b = 0 AND c = 1 UNION ALL SELECT trial, usr, 'transport', 'transport.avoid', mode, -1 FROM lg WHERE a + b + c = 0 AND d = 1),
ht AS (SELECT act.trial, l.usr, act.location, max(CASE WHEN field = 'hotel_preference.prefer' AND list_contains(xs, category) THEN 1 ELSE 0 END) AS a, max(CASE WHEN field = 'hotel_preference.avoid' AND list_contains(xs, category) THEN 1 ELSE 0 END) AS b
  FROM act JOIN res ON res.city = act.city AND res.location = act.location JOIN lst l ON l.trial = act.trial WHERE typ = 'hotel' AND wc = '' GROUP BY act.trial, l.usr, act.location, day_ix, seg_ix, act_ix),
u5 AS (SELECT trial, usr, 'hotel' AS dimension, CASE WHEN a = 1 THEN 'hotel_preference.prefer' ELSE 'hotel_preference.avoid' END AS field, location AS about, CASE WHEN a = 1 THEN 1 ELSE -1 END AS score FROM ht WHERE a + b > 0),
dayly AS (SELECT trial, day_ix, day, usr, sum(CASE WHEN typ = 'attraction' THEN 1 ELSE 0 END) AS places, sum(CASE WHEN typ IN ('attraction', 'intracity_transport') THEN greatest(coalesce(en - st, 0), 0) ELSE 0 END) AS minutes FROM au GROUP BY ALL),
u6 AS (SELECT trial, usr, 'intensity' AS dimension, 'intensity.max_poi_per_day' AS field, CAST(day AS VARCHAR) AS about, -2 AS score FROM dayly WHERE usr <> 'U2' AND trial % 3 > 0 AND places > trial % 3
  UNION ALL SELECT trial, usr, 'intensity', 'intensity.max_active_hours', CAST(day AS VARCHAR), -2 FROM dayly WHERE usr <> 'U2' AND trial % 2 > 0 AND minutes > 60 * (trial % 2)),
legs AS (SELECT trial, sum(leg_cost) AS legs FROM seg WHERE leg GROUP BY trial), hotels AS (SELECT trial, sum(cost) AS hotels FROM act WHERE typ = 'hotel' GROUP BY trial),
eaten AS (SELECT trial, usr, sum(cost) AS meals FROM au WHERE typ = 'food' GROUP BY ALL),
sp AS (SELECT trial, usr, CAST(coalesce(legs, 0) AS DOUBLE) AS legs, CAST(coalesce(hotels, 0) AS DOUBLE) AS hotels, CAST(coalesce(meals, 0) AS DOUBLE) AS meals FROM usr LEFT JOIN legs USING (trial) LEFT JOIN hotels USING (trial) LEFT JOIN eaten USING (trial, usr)),
u7 AS (SELECT trial, usr, 'budget' AS dimension, 'avg_budget' AS field, NULL AS about, -2 AS score FROM sp WHERE usr <> 'U2' AND trial % 90 > 0 AND legs + hotels + meals > trial % 90),
sc AS (SELECT trial, usr, dimension, field, about, score FROM u1 UNION ALL FROM u2 UNION ALL FROM u3 UNION ALL FROM u4 UNION ALL FROM u5 UNION ALL FROM u6 UNION ALL FROM u7),
pu AS (SELECT u.trial, u.usr, {", ".join(f"CAST(coalesce(sum(CASE WHEN dimension = '{d}' THEN score END), 0) AS BIGINT) AS {d}" for d in S.DIMENSIONS)}, CAST(coalesce(sum(score), 0) AS BIGINT) AS total FROM usr u LEFT JOIN sc ON sc.trial = u.trial AND sc.usr = u.usr GROUP BY u.trial, u.usr)"""
)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("trial", "usr", "field", "about", "score")


@query(_SCORES + " SELECT city, location AS place, matched, poi_type, category FROM res")
def q_placedetail(spark, sf_dir):
    """Matched name, type and category of the plans' places."""
    return Scored(spark, sf_dir).known


@query(_SCORES + " SELECT trial, usr, field, about, score FROM u1 UNION ALL SELECT trial, usr, field, about, score FROM u2")
def q_sights(spark, sf_dir):
    """By trial, user and city; visits that U1 named don't count for U2; conflicts count for neither."""
    t = Scored(spark, sf_dir)
    clean = written(t.clean())
    by_name, taken = S.named(clean, t.wishes)
    return _shown(by_name).unionByName(_shown(S.liked(clean, t.wishes, t.known, taken)))


@query(_SCORES + " SELECT trial, usr, field, about, score FROM u3")
def q_meals(spark, sf_dir):
    """Names before categories, and both strong lists by category."""
    t = Scored(spark, sf_dir)
    return _shown(S.meals(t.clean(), t.wishes, t.known))


@query(_SCORES + " SELECT trial, usr, field, about, score FROM u4 UNION ALL SELECT trial, usr, field, about, score FROM u5")
def q_legshotels(spark, sf_dir):
    """Legs and nights, for every user with wishes."""
    t = Scored(spark, sf_dir)
    return _shown(S.modes(t.segments, t.wishes)).unionByName(_shown(S.stays(t.acts, t.wishes, t.known)))


@query(_SCORES + " SELECT trial, usr, field, about, score FROM u6")
def q_pace(spark, sf_dir):
    """Each user's own caps."""
    t = Scored(spark, sf_dir)
    return _shown(S.pace(t.taking, t.wishes))


@query(_SCORES + " SELECT trial, usr, legs, hotels, meals, legs + hotels + meals AS spent, legs + hotels + meals > trial % 90 AND trial % 90 > 0 AND usr <> 'U2' AS above FROM sp")
def q_spending(spark, sf_dir):
    """What is everybody's and what is one's own, and who is above the budget."""
    t = Scored(spark, sf_dir)
    spent = S.spending(t.segments, t.acts, t.taking, t.users)
    above = S.budget(spent, t.wishes).select("trial", "usr", F.lit(True).alias("above"))
    return spent.join(above.hint("merge"), ["trial", "usr"], "left").select("trial", "usr", *[F.col(c).cast("double").alias(c) for c in ("legs", "hotels", "meals", "spent")], F.coalesce("above", F.lit(False)).alias("above"))


@query(_SCORES + " SELECT * FROM pu")
def q_userscores(spark, sf_dir):
    """Each user's sums by dimension."""
    t = Scored(spark, sf_dir)
    return S.per_user(t.scores(), t.users)


_TEAMS = _SCORES + """, tw AS (SELECT trial, day_ix, seg_ix, act_ix, st, en, who FROM act WHERE typ IN ('attraction', 'food', 'rest', 'intracity_transport') AND who IN (3, 4, 6) AND en > st),
e AS (SELECT *, max(en) OVER (PARTITION BY trial, day_ix, seg_ix ORDER BY st, act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM tw),
g AS (SELECT *, sum(CASE WHEN until IS NULL OR until <= st THEN 1 ELSE 0 END) OVER (PARTITION BY trial, day_ix, seg_ix ORDER BY st, act_ix ROWS UNBOUNDED PRECEDING) AS island FROM e),
c AS (SELECT trial, day_ix, seg_ix, island, count(DISTINCT who) AS teams, bool_or(who = 3) AND bool_or(who = 6) AS shared FROM g GROUP BY ALL),
pen AS (SELECT trial, sum(teams - 1) AS penalty FROM c WHERE teams > 1 AND NOT shared GROUP BY trial)"""


@query(_TEAMS + """ SELECT trial, 2 AS n_users, before, penalty, before - penalty AS total, (before - penalty) / 2 AS utility, lo AS low, hi AS high,
  CASE WHEN hi = lo THEN 100.0 WHEN hi > 0 AND lo >= 0 THEN CAST(lo AS DOUBLE) / hi * 100 WHEN hi > 0 THEN 0.0 ELSE CAST(hi AS DOUBLE) / lo * 100 + 0.0 END AS fairness
FROM (SELECT trial, CAST(sum(CASE WHEN usr <> 'U2' THEN total ELSE 0 END) AS BIGINT) AS before, min(total) AS lo, max(total) AS hi FROM pu GROUP BY trial) LEFT JOIN (SELECT trial AS t2, penalty AS pn FROM pen) ON t2 = trial, LATERAL (SELECT CAST(coalesce(pn, 0) AS BIGINT) AS penalty)""")
def q_planutility(spark, sf_dir):
    """U8 to U10, end to end: from plan text to utility and fairness. Users without wishes count for fairness alone."""
    t = Scored(spark, sf_dir)
    each = written(S.per_user(t.scores(), t.users))
    out = S.utility(each, t.wishes.select("trial", "usr"), P.split_penalty(t.acts))
    return out.join(S.plan_fairness(each).hint("merge"), "trial").select("trial", F.col("n_users").cast("int").alias("n_users"), "before", "penalty", "total", "utility", "low", "high", "fairness")
