"""Queries over plans: customers' orders as segments of plans in JSON text, which the operators take apart again.

The facts of a segment and an activity are expressions that Spark and DuckDB both understand. Here they are
nested into JSON; the SQL twins use them flat, so that they never see the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.functions import jsonx
from tripfold.operators import itinerary as I
from tripfold.operators import plans as P
from tripfold.plans.adapters import table
from tripfold.session import written

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _clock(m: str) -> str:
    return f"concat(CAST(CAST(floor(({m}) / 60) AS INT) AS STRING), ':', CAST(({m}) % 60 AS STRING))"


_FACTS = "CAST(o_orderkey * 7 % 20011 AS INT) AS p, CAST(o_orderkey * 3 % 1009 AS INT) AS s, CAST(floor(o_totalprice) AS INT) % 50 + 1 AS q"
# of a segment, from trial, i (the order's place among its customer's) and the numbers p, s, q
_SEGMENT = {
    "day_ix": "CAST(floor(i / 3) AS INT)",
    "seg_ix": "CAST(i % 3 AS INT)",
    "leg": "p % 5 = 0",
    "to_city": "CASE WHEN p % 35 <> 0 THEN concat('C', CAST(s % 4 AS STRING), CASE WHEN p % 3 = 0 THEN '市' ELSE '' END) END",
    "from_city": "concat('C', CAST(q % 4 AS STRING))",
    "city": "CASE WHEN s % 19 > 1 THEN concat('C', CAST(s % 4 AS STRING), CASE WHEN q % 2 = 0 THEN '市' ELSE '' END) END",
    "has_city": "s % 19 <> 0",
    "acts": "CASE p % 13 WHEN 1 THEN 'absent' WHEN 2 THEN 'null' WHEN 3 THEN 'empty' ELSE 'some' END",
    "k": "1 + q % 4",
    "leg_st": "CASE WHEN p % 40 <> 0 THEN p * 37 % 1440 END",
    "leg_en": "(p * 37 + q * 30) % 1440",
    "leg_cost": "CASE WHEN s % 3 > 0 THEN q END",
    "mode": "CASE WHEN q % 5 = 1 THEN '' WHEN q % 5 > 1 THEN concat('M', CAST(p % 3 AS STRING)) END",
}
# of its activity j, with a standing for the number below
_NUMBER = "(p * 7 + s * 3 + j)"
_ACTIVITY = {
    "typ": "CASE a % 6 WHEN 0 THEN 'attraction' WHEN 1 THEN 'food' WHEN 2 THEN 'hotel' WHEN 3 THEN 'intracity_transport' WHEN 4 THEN 'rest' ELSE 'photo' END",
    "location": "CASE WHEN a % 6 > 2 OR a % 11 = 0 THEN NULL WHEN a % 29 = 0 THEN '' ELSE concat('L', CAST(a % 5 AS STRING)) END",
    "frm": "CASE WHEN a % 6 = 3 THEN concat('L', CAST((a + 1) % 5 AS STRING)) END",
    "too": "CASE WHEN a % 6 = 3 AND a % 17 > 0 THEN concat('L', CAST(a % 7 AS STRING)) END",
    "st": "CAST((p * 11 + j * 60) % 1440 AS INT)",
    "en": "CASE WHEN a % 31 <> 0 THEN CAST((p * 11 + j * 60 + 20 + q * 2) % 1440 AS INT) END",
    "who": "CAST((a + q) % 7 AS INT)",
    "cost": "CASE WHEN (a + q) % 4 > 1 THEN q END",
}
_WHO = ("", ',"participants":[]', ',"participants":["All"]', ',"participants":["U0"]', ',"participants":["U1","U2"]', ',"participants":"U1"', ',"participants":["U0","Bob","U0"]')
_NO_DAYS = "c_custkey % 23"  # 0: days are null; 1: no days at all
_NO_SEGMENTS = "(trial + day_ix) % 17"  # 0: null, 1: an empty list


def _json(*fields: str) -> str:
    return "concat('{', array_join(filter(array(" + ", ".join(fields) + "), x -> x IS NOT NULL), ','), '}')"


def _string(name: str, value: str) -> str:
    return f"""concat('"{name}":"', {value}, '"')"""


def plan_texts(spark, sf_dir: str) -> DataFrame:
    """trial and its plan as JSON text: a customer's orders are segments, three a day."""
    lines = table(spark, sf_dir, "orders").selectExpr("o_custkey AS trial", f"struct(o_orderkey, {_FACTS}) AS l")
    seg = lines.groupBy("trial").agg(F.array_sort(F.collect_list("l")).alias("l")).select("trial", F.posexplode("l").alias("i", "l")).select("trial", "i", "l.p", "l.s", "l.q")
    seg = seg.selectExpr("trial", "p", "s", "q", *[f"{e} AS {n}" for n, e in _SEGMENT.items()])
    at = {n: "(" + e.replace("a % ", f"{_NUMBER} % ").replace("(a +", f"({_NUMBER} +") + ")" for n, e in _ACTIVITY.items()}
    who = "CASE " + at["who"] + " " + " ".join(f"WHEN {i} THEN '{w[1:]}'" for i, w in enumerate(_WHO) if w) + " END"
    act = _json(
        _string("type", at["typ"]), _string("location", at["location"]), _string("from", at["frm"]), _string("to", at["too"]), _string("start_time", _clock(at["st"])),
        f"""concat('"end_time":"', CASE WHEN {at["en"]} IS NULL THEN 'x' ELSE {_clock(at["en"])} END, '"')""",
        f"""CASE WHEN {at["cost"]} IS NOT NULL THEN concat('"avg_cost":', CAST({at["cost"]} AS STRING)) WHEN {_NUMBER} % 2 = 0 THEN '"avg_cost":null' END""", who,
    )
    acts = f"""CASE acts WHEN 'null' THEN '"activities":null' WHEN 'empty' THEN '"activities":[]' WHEN 'some' THEN concat('"activities":[', array_join(transform(sequence(0, k - 1), j -> {act}), ','), ']') END"""
    leg = _json(
        "'\"type\":\"intercity_transport\"'", _string("from_city", "from_city"), _string("to_city", "to_city"), _string("transport_mode", "mode"), f"""concat('"start_time":"', CASE WHEN leg_st IS NULL THEN '25:00' ELSE {_clock("leg_st")} END, '"')""",
        _string("end_time", _clock("leg_en")), """concat('"avg_cost":"', CAST(leg_cost AS STRING), '"')""",
    )
    block = _json("""CASE WHEN NOT has_city THEN NULL WHEN city IS NULL THEN '"city":null' ELSE concat('"city":"', city, '"') END""", acts)
    json = seg.selectExpr("trial", "day_ix", "seg_ix", f"CASE WHEN leg THEN {leg} ELSE {block} END AS json")
    told = F.expr("array_join(transform(array_sort(collect_list(struct(seg_ix, json))), x -> x.json), ',')")
    day = json.groupBy("trial", "day_ix").agg(told.alias("json"))
    listed = f"CASE {_NO_SEGMENTS} WHEN 0 THEN 'null' WHEN 1 THEN '[]' ELSE concat('[', json, ']') END"
    day = day.selectExpr("trial", "day_ix", f"""concat('{{"day":', CAST(day_ix + 1 AS STRING), CASE WHEN trial % 7 > 0 THEN ',"date":"2025-01-01"' ELSE '' END, ',"city_segments":', {listed}, '}}') AS json""")
    told = F.expr("array_join(transform(array_sort(collect_list(struct(day_ix, json))), x -> x.json), ',')")
    plan = day.groupBy(F.col("trial").alias("_t")).agg(told.alias("json"))
    everyone = table(spark, sf_dir, "customer").join(plan.hint("merge"), F.col("c_custkey") == F.col("_t"), "left")  # the texts are far longer than Spark guesses
    text = f"CASE {_NO_DAYS} WHEN 0 THEN '{{\"days\":null}}' WHEN 1 THEN '{{\"days\":[]}}' ELSE concat('{{\"days\":[', coalesce(json, ''), ']}}') END"
    return everyone.selectExpr("c_custkey AS trial", f"{text} AS plan")


class Planned:
    """The operators' tables, from plan text."""

    def __init__(self, spark, sf_dir: str):
        texts = written(plan_texts(spark, sf_dir))
        self.days = P.days(texts.select("trial", jsonx.strict_variant("plan").alias("plan")))
        self.segments = P.segments(self.days)
        self.acts = P.activities(self.segments)
        self.segments, self.acts = written(self.segments.drop("_acts")), written(self.acts)
        self.users = texts.select("trial", F.explode(F.array(*map(F.lit, ("U0", "U1", "U2")))).alias("usr"))

    def line(self) -> DataFrame:
        return P.timeline(self.segments, self.acts, self.users)


_FLAT = f"""
ln AS (SELECT o_custkey AS trial, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, {_FACTS} FROM orders),
sg AS (SELECT trial, p, s, q, {", ".join(f"{e} AS {n}" for n, e in _SEGMENT.items())} FROM ln),
dy AS (SELECT DISTINCT trial, day_ix, day_ix + 1 AS day FROM sg JOIN customer ON c_custkey = trial WHERE {_NO_DAYS} > 1),
seg AS (SELECT sg.*, day_ix + 1 AS day FROM sg JOIN customer ON c_custkey = trial WHERE {_NO_DAYS} > 1 AND {_NO_SEGMENTS} > 1),
nm AS (SELECT seg.*, j, {_NUMBER} AS a FROM seg, range(4) t(j) WHERE NOT leg AND acts = 'some' AND j < k),
act AS (SELECT trial, day_ix, day, seg_ix, CAST(j AS INT) AS act_ix, city, {", ".join(f"{e} AS {n}" for n, e in _ACTIVITY.items())} FROM nm),
usr AS (SELECT c_custkey AS trial, u AS usr, CAST(right(u, 1) AS INT) AS n FROM customer, (VALUES ('U0'), ('U1'), ('U2')) v(u)),
line AS (SELECT trial, day_ix, day, seg_ix, -1 AS act_ix, n AS who_ix, usr, 'intercity_transport' AS typ, NULL AS city, NULL AS starts, NULL AS ends, leg_st AS st, leg_en AS en FROM seg JOIN usr USING (trial) WHERE leg
  UNION ALL SELECT trial, day_ix, day, seg_ix, act_ix, who_ix, name, typ, city, CASE WHEN typ = 'intracity_transport' THEN frm ELSE location END, CASE WHEN typ = 'intracity_transport' THEN too ELSE location END, st, en
  FROM act JOIN (VALUES (0, 0, 'U0'), (0, 1, 'U1'), (0, 2, 'U2'), (1, 0, 'U0'), (1, 1, 'U1'), (1, 2, 'U2'), (2, 0, 'U0'), (2, 1, 'U1'), (2, 2, 'U2'), (3, 0, 'U0'), (4, 0, 'U1'), (4, 1, 'U2'),
    (5, 0, 'U0'), (5, 1, 'U1'), (5, 2, 'U2'), (6, 0, 'U0'), (6, 1, 'Bob'), (6, 2, 'U0')) w(who, who_ix, name) USING (who))"""
_FLAT = "WITH " + _FLAT.strip()


@query(_FLAT + """ SELECT trial, day_ix, seg_ix, -1 AS act_ix, 'intercity_transport' AS typ, to_city AS city, CAST(leg_st AS INT) AS st, CAST(leg_en AS INT) AS en, CAST(leg_cost AS VARCHAR) AS cost, NULL AS who_kind FROM seg WHERE leg
UNION ALL SELECT trial, day_ix, seg_ix, act_ix, typ, city, st, en, CAST(cost AS VARCHAR), CASE who WHEN 0 THEN NULL WHEN 5 THEN 'string' ELSE 'array' END FROM act""")
def q_planrows(spark, sf_dir):
    """Legs and activities of plans in JSON text; every level is null or empty somewhere."""
    t = Planned(spark, sf_dir)
    legs = t.segments.where("kind = 'intercity'").selectExpr("trial", "day_ix", "seg_ix", "-1 AS act_ix", "'intercity_transport' AS typ", "to_city AS city", "st", "en", "cost", "CAST(NULL AS STRING) AS who_kind")
    return legs.unionByName(t.acts.select(legs.columns))


@query(_FLAT + " SELECT trial, day_ix, seg_ix, act_ix, who_ix, usr, typ, starts, ends, CAST(st AS INT) AS st, CAST(en AS INT) AS en FROM line")
def q_dayline(spark, sf_dir):
    """Who does what, in the order of the lists; legs for everybody."""
    return Planned(spark, sf_dir).line().drop("day", "city")


@query(_FLAT + """, z AS (SELECT *, CASE WHEN typ = 'intercity_transport' THEN '@hub' WHEN typ = 'hotel' THEN nullif(ends, '') ELSE ends END AS put FROM line),
w AS (SELECT *, last_value(put IGNORE NULLS) OVER (PARTITION BY trial, day_ix, usr ORDER BY seg_ix, act_ix, who_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM z)
SELECT trial, day_ix, seg_ix, act_ix, who_ix, usr, nullif(was, '@hub') AS from_place, starts AS to_place, CASE WHEN was = '@hub' OR typ <> 'intracity_transport' THEN 'missing_intracity_transport' ELSE 'intracity_transport_origin_mismatch' END AS issue
FROM w WHERE typ NOT IN ('rest', 'intercity_transport') AND CASE WHEN was = '@hub' THEN typ <> 'intracity_transport' ELSE coalesce(was <> starts, false) END""")
def q_transfers(spark, sf_dir):
    """V7: missing and wrong transfers, with the hub after a leg, rests, and names that are unknown or repeated."""
    return P.transfers(Planned(spark, sf_dir).line()).drop("day", "city")


@query(_FLAT + """, o AS (SELECT DISTINCT trial, day_ix, usr, seg_ix, act_ix, typ, st, en FROM line WHERE usr <> 'Bob'),
w AS (SELECT *, last_value(CASE WHEN typ <> 'hotel' AND (st IS NULL OR en >= st) THEN en END IGNORE NULLS) OVER (PARTITION BY trial, day_ix, usr ORDER BY seg_ix, act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM o)
SELECT trial, day_ix, usr, seg_ix, act_ix, typ, CAST(st AS INT) AS st, CAST(clock AS INT) AS clock FROM w WHERE st < clock""")
def q_backwards(spark, sf_dir):
    """V8 by list order, with legs; ends past midnight and hotels leave the clock where it was."""
    t = Planned(spark, sf_dir)
    return P.backwards(t.line(), t.users).drop("day")


_KEY = "regexp_replace({}, '(.)市$', '\\1')"
_CITIES = """, see AS (SELECT trial, day_ix, day, seg_ix, leg, CASE WHEN leg THEN to_city ELSE city END AS v FROM seg WHERE leg OR has_city),
ends AS (SELECT dy.trial, dy.day_ix, arg_min_null(v, seg_ix) AS first_city, arg_max_null(v, seg_ix) AS last_city FROM dy LEFT JOIN see USING (trial, day_ix) GROUP BY ALL)""".replace("arg_min_null(v, seg_ix)", "first(v ORDER BY seg_ix)").replace("arg_max_null(v, seg_ix)", "last(v ORDER BY seg_ix)")


@query(_FLAT + _CITIES + " SELECT * FROM ends")
def q_daycities(spark, sf_dir):
    """By list order; a day without a city, and one whose first city is null."""
    t = Planned(spark, sf_dir)
    return P.day_cities(t.days, t.segments).drop("day")


@query(_FLAT + _CITIES + f""", w AS (SELECT *, CASE WHEN leg THEN coalesce(v, '') ELSE v END AS here FROM see), p AS (SELECT *, lag(here) OVER (PARTITION BY trial, day_ix ORDER BY seg_ix) AS was FROM w),
b AS (SELECT trial, day_ix, arg_min(leg, seg_ix) AS leg FROM seg GROUP BY ALL), n AS (SELECT *, lag(last_city) OVER (PARTITION BY trial ORDER BY day_ix) AS night FROM ends)
SELECT trial, day_ix, seg_ix, was AS from_city, v AS to_city FROM p WHERE NOT leg AND was IS NOT NULL AND was IS DISTINCT FROM v AND {_KEY.format('was')} IS DISTINCT FROM {_KEY.format('v')}
UNION ALL SELECT n.trial, n.day_ix, NULL, night, first_city FROM n LEFT JOIN b ON b.trial = n.trial AND b.day_ix = n.day_ix
WHERE night <> '' AND first_city <> '' AND night <> first_city AND {_KEY.format('night')} <> {_KEY.format('first_city')} AND NOT coalesce(leg, false)""")
def q_citychange(spark, sf_dir):
    """V1, V2: within a day and over night, with the exemption of legs and the names' suffixes."""
    t = Planned(spark, sf_dir)
    return P.city_changes(t.days, t.segments).drop("day")


@query(_FLAT + """, b AS (SELECT trial, day_ix, max(seg_ix) AS blk FROM seg WHERE NOT leg AND acts <> 'absent' GROUP BY ALL),
f AS (SELECT trial, day_ix, arg_max(seg_ix, (seg_ix, act_ix)) AS ls, arg_max(typ, (seg_ix, act_ix)) AS lt, bool_or(typ = 'hotel') AS anyh FROM act GROUP BY ALL),
e AS (SELECT trial, max(day_ix) AS top FROM dy GROUP BY trial)
SELECT * FROM (SELECT trial, day_ix, CASE WHEN blk IS NULL OR ls IS DISTINCT FROM blk THEN 'missing_hotel' WHEN lt <> 'hotel' THEN CASE WHEN anyh THEN 'hotel_not_last_activity' ELSE 'missing_hotel' END END AS issue
FROM dy JOIN e USING (trial) LEFT JOIN b USING (trial, day_ix) LEFT JOIN f USING (trial, day_ix) WHERE day_ix < top) WHERE issue IS NOT NULL""")
def q_nights(spark, sf_dir):
    """V3: the last activity of the last block, blocks that are empty, null or not there."""
    t = Planned(spark, sf_dir)
    return P.nights_without_hotel(t.days, t.segments, t.acts).drop("day")


@query(_FLAT + """, b AS (SELECT trial, day_ix, seg_ix, -1 AS act_ix, 'intercity_transport' AS typ, leg_st AS st, leg_en AS en FROM seg WHERE leg UNION ALL SELECT trial, day_ix, seg_ix, act_ix, typ, st, en FROM act WHERE typ <> 'hotel')
SELECT * FROM (SELECT trial, day_ix, seg_ix, act_ix, typ, CASE WHEN st IS NULL OR en IS NULL THEN 'invalid_time_format' WHEN en <= st AND act_ix >= 0 THEN 'invalid_time_range' END AS issue FROM b) WHERE issue IS NOT NULL""")
def q_plantimes(spark, sf_dir):
    """V4: legs may go past midnight."""
    t = Planned(spark, sf_dir)
    return P.time_issues(t.segments, t.acts).drop("day")


@query(_FLAT + """ SELECT trial, day_ix, seg_ix, -1 AS act_ix, 'intercity_transport' AS typ FROM seg WHERE leg AND leg_cost IS NULL UNION ALL SELECT trial, day_ix, seg_ix, act_ix, typ FROM act WHERE typ IN ('food', 'hotel') AND cost IS NULL""")
def q_plancosts(spark, sf_dir):
    """V9: costs that are null, and those that aren't there."""
    t = Planned(spark, sf_dir)
    return P.missing_costs(t.segments, t.acts).drop("day")


@query(_FLAT + """ SELECT trial, day_ix, seg_ix, act_ix, CASE who WHEN 1 THEN 'empty' WHEN 5 THEN 'not_a_list' ELSE 'unknown' END AS issue, CASE who WHEN 6 THEN 1 END AS who_ix, CASE who WHEN 6 THEN 'Bob' END AS name FROM act WHERE typ <> 'hotel' AND who IN (1, 5, 6)""")
def q_planpeople(spark, sf_dir):
    """No list, an empty list, a stranger."""
    t = Planned(spark, sf_dir)
    return P.wrong_participants(t.acts, t.users).drop("day")


@query(_FLAT + """, tm AS (SELECT trial, day_ix, seg_ix, act_ix, st, en, who FROM act WHERE typ IN ('attraction', 'food', 'rest', 'intracity_transport') AND who IN (3, 4, 6) AND en > st),
e AS (SELECT *, max(en) OVER (PARTITION BY trial, day_ix, seg_ix ORDER BY st, act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM tm),
g AS (SELECT *, sum(CASE WHEN until IS NULL OR until <= st THEN 1 ELSE 0 END) OVER (PARTITION BY trial, day_ix, seg_ix ORDER BY st, act_ix ROWS UNBOUNDED PRECEDING) AS island FROM e),
c AS (SELECT trial, day_ix, seg_ix, CAST(island AS BIGINT) AS island, count(DISTINCT who) AS teams, bool_or(who = 3) AND bool_or(who = 6) AS shared FROM g GROUP BY ALL)
SELECT trial, day_ix, seg_ix, island, teams, teams - 1 AS penalty FROM c WHERE teams > 1 AND NOT shared""")
def q_teams(spark, sf_dir):
    """U8: lists that overlap, are equal but for repeats, are ["All"], empty, absent or no lists."""
    return P.split_penalty(Planned(spark, sf_dir).acts).drop("day")


@query(_FLAT + """, bad AS (SELECT trial, 'missing_avg_cost' AS issue FROM seg WHERE leg AND leg_cost IS NULL UNION ALL SELECT trial, 'missing_avg_cost' FROM act WHERE typ IN ('food', 'hotel') AND cost IS NULL
  UNION ALL SELECT trial, 'invalid_participants' FROM act WHERE typ <> 'hotel' AND who IN (1, 5, 6)
  UNION ALL SELECT trial, CASE WHEN st IS NULL OR en IS NULL THEN 'invalid_time_format' ELSE 'invalid_time_range' END FROM act WHERE typ <> 'hotel' AND (st IS NULL OR en IS NULL OR en <= st)
  UNION ALL SELECT trial, 'invalid_time_format' FROM seg WHERE leg AND leg_st IS NULL),
n AS (SELECT trial, issue, count(*) AS n FROM bad GROUP BY ALL), t AS (SELECT trial, sum(n) AS total, string_agg(concat(issue, '=', CAST(n AS VARCHAR)), ',' ORDER BY issue) AS counts FROM n GROUP BY trial)
SELECT c_custkey AS trial, total IS NULL AS valid, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(counts, '') AS counts FROM customer LEFT JOIN t ON c_custkey = trial""")
def q_planvalid(spark, sf_dir):
    """V11 over V4, V9 and V10 of plan text."""
    t = Planned(spark, sf_dir)
    named = lambda df, name: df.select("trial", F.lit(name).alias("issue"))
    found = named(P.missing_costs(t.segments, t.acts), "missing_avg_cost").unionByName(named(P.wrong_participants(t.acts, t.users), "invalid_participants"))
    found = found.unionByName(P.time_issues(t.segments, t.acts).select("trial", "issue"))
    out = I.issue_rollup(found, t.users.select("trial").distinct(), "trial")
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("trial", "valid", "total", shown.alias("counts"))
