"""Queries of the itinerary family: events as activities of a person's day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripfold.functions import times
from tripfold.operators import itinerary as I
from tripfold.plans.adapters import ACTIVITIES, activities, table

QUERIES, SQL = {}, {}
DAY = ["usr", "d"]
_TIMED = f"WITH {ACTIVITIES}, tm AS (SELECT * FROM evt WHERE typ <> 'hotel' AND en > st)"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(_TIMED + """ SELECT a.usr, a.d, a.ix AS ix_a, b.ix AS ix_b FROM tm a JOIN tm b ON a.usr = b.usr AND a.d = b.d AND a.ix < b.ix AND a.st < b.en AND b.st < a.en""")
def q_overlap(spark, sf_dir):
    """J7, V5, F2."""
    return I.overlap_pairs(activities(spark, sf_dir), DAY)


@query(_TIMED + """ SELECT usr, d, ix, typ, st, en FROM evt WHERE NOT (typ <> 'hotel' AND en > st AND EXISTS (SELECT 1 FROM tm b
  WHERE b.usr = evt.usr AND b.d = evt.d AND b.ix <> evt.ix AND evt.st < b.en AND b.st < evt.en))""")
def q_anti(spark, sf_dir):
    """Activities without a conflict."""
    return I.with_conflict(activities(spark, sf_dir), DAY).where("not conflict").select("usr", "d", "ix", "typ", "st", "en")


_ISLANDS = """, r AS (SELECT *, max(en) OVER (PARTITION BY {0} ORDER BY st, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {1}),
isl AS (SELECT *, sum(CASE WHEN e IS NULL OR e <= st THEN 1 ELSE 0 END) OVER (PARTITION BY {0} ORDER BY st, ix ROWS UNBOUNDED PRECEDING) AS island FROM r)"""


@query(_TIMED + _ISLANDS.format("usr, d", "tm") + " SELECT usr, d, CAST(island AS BIGINT) AS island, min(st) AS st, max(en) AS en, count(*) AS n FROM isl GROUP BY usr, d, island")
def q_islands(spark, sf_dir):
    g = I.islands(activities(spark, sf_dir), DAY).groupBy("usr", "d", F.col("island").cast("long").alias("island"))
    return g.agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n"))


@query(_TIMED + ", sp AS (SELECT * FROM tm WHERE typ IN ('attraction', 'food', 'rest', 'intracity_transport'))" + _ISLANDS.format("d", "sp")
       + " SELECT d, CAST(island AS BIGINT) AS island, count(DISTINCT usr) AS teams, count(DISTINCT usr) - 1 AS penalty FROM isl GROUP BY d, island HAVING count(DISTINCT usr) > 1")
def q_split(spark, sf_dir):
    """U8: a day is a segment, a person a team."""
    return I.split_penalty(activities(spark, sf_dir), ["d"], "usr").withColumn("island", F.col("island").cast("long"))


LIST = ["ls", "ix"]
_BEFORE = "OVER (PARTITION BY usr, d ORDER BY ls, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {ACTIVITIES} SELECT usr, d, ix, st FROM (SELECT *, last_value(CASE WHEN typ <> 'hotel' AND en >= st THEN en END IGNORE NULLS) {_BEFORE} AS l FROM evt) WHERE st < l")
def q_timeline(spark, sf_dir):
    """V8: in the order of the lists, whose clocks aren't sorted."""
    return I.backwards(activities(spark, sf_dir), DAY, LIST, F.col("ls")).select("usr", "d", "ix", "st")


@query(f"WITH {ACTIVITIES} SELECT usr, d, ix, loc, l AS came_from FROM (SELECT *, last_value(CASE WHEN typ <> 'rest' THEN loc END IGNORE NULLS) {_BEFORE} AS l FROM evt) WHERE typ <> 'rest' AND l <> loc")
def q_lastnn(spark, sf_dir):
    return I.misplaced(activities(spark, sf_dir), DAY, LIST, F.col("ls")).select("usr", "d", "ix", "loc", "came_from")


@query(f"WITH {ACTIVITIES} SELECT usr, ix, loc, b AS before FROM (SELECT *, lag(loc) OVER (PARTITION BY usr, d ORDER BY ls, ix) AS b FROM evt) WHERE b <> loc")
def q_lagcity(spark, sf_dir):
    """V1: the place changes within a day."""
    return I.place_changes(activities(spark, sf_dir), DAY, "loc", LIST, F.col("ls")).select("usr", "ix", "loc", "before")


@query(f"""WITH {ACTIVITIES}, e AS (SELECT usr, d, arg_min(loc, (ls, ix)) AS first_place, arg_max(loc, (ls, ix)) AS last_place FROM evt GROUP BY usr, d)
SELECT usr, d, first_place, last_place, lag(last_place) OVER (PARTITION BY usr ORDER BY d) AS night_before,
  coalesce(lag(last_place) OVER (PARTITION BY usr ORDER BY d) <> first_place, false) AS jumped FROM e""")
def q_firstlast(spark, sf_dir):
    """Where days begin and end, and whether a day begins elsewhere than the one before ended."""
    from pyspark.sql.window import Window

    ends = I.day_ends(activities(spark, sf_dir), DAY, "loc", LIST)
    night = F.lag("last_place").over(Window.partitionBy("usr").orderBy("d"))  # a row a day
    return ends.withColumn("night_before", night).withColumn("jumped", F.coalesce(F.col("night_before") != F.col("first_place"), F.lit(False)))


@query(f"""WITH {ACTIVITIES}, g AS (SELECT usr, d, bool_or(typ = 'hotel') AS any_hotel, arg_max(typ, (ls, ix)) AS l FROM evt GROUP BY usr, d)
SELECT * FROM (SELECT usr, d, CASE WHEN NOT any_hotel THEN 'no_hotel' WHEN l <> 'hotel' THEN 'hotel_not_last' END AS issue FROM g
  WHERE d < (SELECT max(d) FROM g h WHERE h.usr = g.usr)) WHERE issue IS NOT NULL""")
def q_hotel(spark, sf_dir):
    return I.nights_without_hotel(activities(spark, sf_dir), "usr", "d", LIST)


@query(f"""WITH {ACTIVITIES}, g AS (SELECT usr, d, CAST(sum(CASE WHEN typ = 'attraction' THEN 1 ELSE 0 END) AS BIGINT) AS places,
  CAST(sum(CASE WHEN typ IN ('attraction', 'intracity_transport') THEN greatest(en - st, 0) ELSE 0 END) AS BIGINT) AS minutes FROM evt GROUP BY usr, d)
SELECT * FROM (SELECT *, CASE WHEN places > 2 THEN -2 ELSE 0 END + CASE WHEN minutes > 240 THEN -2 ELSE 0 END AS score FROM g) WHERE score < 0""")
def q_intensity(spark, sf_dir):
    return I.intensity(activities(spark, sf_dir), DAY, 2, 240)


@query("""SELECT c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) * 100 AS budget, -2 AS score
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal
HAVING CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) > CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) * 100""")
def q_budget(spark, sf_dir):
    """Customers whose orders cost more than a hundred times their balance."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    caps = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal").cast("decimal(18,2)").cast("double") * 100).alias("budget"))
    return spent.join(caps, F.col("o_custkey") == F.col("c_custkey")).where("spent > budget").select("c_custkey", "spent", "budget", F.lit(-2).alias("score"))


_CLOCKS = f"""WITH {ACTIVITIES}, c AS (SELECT *, CASE ix % 7 WHEN 0 THEN '24:00' WHEN 1 THEN concat(CAST(st // 60 AS VARCHAR), ':', CAST(st % 60 AS VARCHAR), 'x')
  ELSE concat(CAST(st // 60 AS VARCHAR), ':', CAST(st % 60 AS VARCHAR)) END AS s, concat(CAST(en // 60 AS VARCHAR), ':', CAST(en % 60 AS VARCHAR)) AS e FROM evt),
m AS (SELECT *, CASE WHEN regexp_full_match(s, '(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9])') THEN CAST(split_part(s, ':', 1) AS INT) * 60 + CAST(split_part(s, ':', 2) AS INT) END AS sm,
  CAST(split_part(e, ':', 1) AS INT) * 60 + CAST(split_part(e, ':', 2) AS INT) AS em FROM c)"""


@query(_CLOCKS + " SELECT * FROM (SELECT ix, CASE WHEN sm IS NULL OR em IS NULL THEN 'bad_time' WHEN em <= sm THEN 'end_before_start' END AS issue FROM m WHERE typ <> 'hotel') WHERE issue IS NOT NULL")
def q_timefmt(spark, sf_dir):
    """V4, F1 on clock texts, two of seven of them broken."""
    clock = lambda c: F.concat(F.expr(f"{c} div 60").cast("string"), F.lit(":"), (F.col(c) % 60).cast("string"))
    a = activities(spark, sf_dir).withColumn("s", F.when(F.col("ix") % 7 == 0, "24:00").when(F.col("ix") % 7 == 1, F.concat(clock("st"), F.lit("x"))).otherwise(clock("st"))).withColumn("e", clock("en"))
    return I.time_issues(a, times.minutes("s"), times.minutes("e")).select("ix", "issue")


@query(f"WITH {ACTIVITIES} SELECT ix, typ FROM evt WHERE typ IN ('food', 'hotel') AND (CASE WHEN ix % 3 > 0 THEN cost END) IS NULL")
def q_nullcheck(spark, sf_dir):
    """V9: paid activities without a cost; every third has none."""
    cost = F.when(F.col("ix") % 3 > 0, F.col("cost"))
    return activities(spark, sf_dir).where(F.col("typ").isin("food", "hotel") & cost.isNull()).select("ix", "typ")


@query(f"""WITH {ACTIVITIES}, p AS (SELECT ix, usr, CASE ix % 5 WHEN 0 THEN [] WHEN 1 THEN ['All'] WHEN 2 THEN [concat('U', CAST(usr % 4 AS VARCHAR)), 'Bob'] ELSE [concat('U', CAST(usr % 4 AS VARCHAR))] END AS who FROM evt WHERE typ <> 'hotel'),
u AS (SELECT ix, unnest(who) AS name FROM p)
SELECT ix, 'empty' AS issue, CAST(NULL AS VARCHAR) AS name FROM p WHERE len(who) = 0
UNION ALL SELECT ix, 'unknown', name FROM u WHERE name NOT IN ('U0', 'U1', 'U2', 'U3', 'All')""")
def q_except(spark, sf_dir):
    """Lists of participants that are empty or name nobody of the group."""
    u = F.concat(F.lit("U"), (F.col("usr") % 4).cast("string"))
    m = F.col("ix") % 5
    who = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("All"))).when(m == 2, F.array(u, F.lit("Bob"))).otherwise(F.array(u))
    p = activities(spark, sf_dir).where("typ <> 'hotel'").select("ix", who.alias("who"))
    known = F.array(*map(F.lit, ("U0", "U1", "U2", "U3", "All")))
    names = F.when(F.size("who") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_except("who", known))
    return p.withColumn("name", F.explode(names)).select("ix", F.when(F.col("name").isNull(), "empty").otherwise("unknown").alias("issue"), "name")


@query(_TIMED + """, c AS (SELECT usr, 'overlap' AS issue FROM tm a WHERE EXISTS (SELECT 1 FROM tm b WHERE b.usr = a.usr AND b.d = a.d AND b.ix <> a.ix AND a.st < b.en AND b.st < a.en)
  UNION ALL SELECT usr, 'no_cost' FROM evt WHERE typ = 'food' AND ix % 3 = 0), g AS (SELECT usr, issue, count(*) AS n FROM c GROUP BY usr, issue)
SELECT usr, total IS NULL AS valid, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(shown, '') AS counts FROM (SELECT DISTINCT usr FROM evt)
LEFT JOIN (SELECT usr, sum(n) AS total, string_agg(concat(issue, '=', CAST(n AS VARCHAR)), ',' ORDER BY issue) AS shown FROM g GROUP BY usr) USING (usr)""")
def q_rollup(spark, sf_dir):
    """Issues of two checks, by person."""
    a = activities(spark, sf_dir)
    found = I.with_conflict(a, DAY).where("conflict").select("usr", F.lit("overlap").alias("issue"))
    found = found.unionByName(a.where("typ = 'food' and ix % 3 = 0").select("usr", F.lit("no_cost").alias("issue")))
    out = I.issue_rollup(found, a.select("usr").distinct(), "usr")
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("usr", "valid", "total", shown.alias("counts"))
