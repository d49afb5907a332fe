"""Queries over preferences: customers as users of trials of three, their preferences as JSON, orders as edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.functions import jsonx
from tripfold.operators import preferences as P
from tripfold.operators import scoring as S
from tripfold.plans.adapters import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: A user's preferences, by customer number k and nation n. {m} stands for the part that differs between snapshots.
_PREFERENCE = """concat('{{"global_constraints":{{', CASE WHEN k % 5 > 0 THEN concat('"avg_budget":', CAST((k * 13 + {m}) % 400 AS STRING), ',') ELSE '' END,
  '"transport":', CASE WHEN k % 4 = 1 THEN '"none"' ELSE concat('{{"must":["T', CAST((k + {m}) % 3 AS STRING), '","bus","bus"],"prefer":[]}}') END,
  ',"intensity":{{"max_poi_per_day":', CAST((k + {m}) % 6 AS STRING), '}}', CASE WHEN k % 3 > 0 THEN ',"hotel_preference":{{"prefer":["H1","H2"],"avoid":null}}' ELSE ',"hotel_preference":null' END,
  '}},"city_specific_preferences":', CASE WHEN k % 7 = 0 THEN '[]' ELSE concat('{{"C', CAST(n AS STRING), '":{{"attractions":{{"must_visit":["A', CAST(k % 9 AS STRING), '"],"category_pref":{{"positive":["P', CAST((k + {m}) % 2 AS STRING), '"]}}}}',
  CASE WHEN k % 5 <> 2 THEN concat(',"food":{{"must_eat":["F', CAST(k % 4 AS STRING), '"],"avoid_eat":["F1","F2"]}}') ELSE ',"food":"any"' END, '}}}}') END, '}}')"""


def snapshot(spark, sf_dir: str, other: int = 0) -> DataFrame:
    """trial and prefs, a VARIANT of all users' preferences; every second user's is wrapped. other: another snapshot, unlike the first."""
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey AS n", "CAST(floor(c_custkey / 3) AS BIGINT) AS trial")
    one = F.expr(_PREFERENCE.format(m=other))
    slot = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"preference":'), one, F.lit(',"compromisable":true}'))).otherwise(one)
    told = users.select("trial", F.concat(F.lit('"U'), F.col("k").cast("string"), F.lit('":'), slot).alias("_j")).groupBy("trial").agg(F.array_join(F.collect_list("_j"), ",").alias("_j"))
    return told.select("trial", jsonx.strict_variant(F.concat(F.lit("{"), F.col("_j"), F.lit("}"))).alias("prefs"))


_USERS = "u AS (SELECT c_custkey AS k, c_nationkey AS n, CAST(floor(c_custkey / 3) AS BIGINT) AS trial, concat('U', CAST(c_custkey AS VARCHAR)) AS usr FROM customer)"


def _items_sql(name: str, m: int) -> str:
    city = "concat('C', CAST(n AS VARCHAR))"
    return f"""{name} AS (SELECT trial, usr, k, NULL AS city, 'avg_budget' AS field, 'scalar' AS kind, 0 AS ord, CAST((k * 13 + {m}) % 400 AS VARCHAR) AS value FROM u WHERE k % 5 > 0
  UNION ALL SELECT trial, usr, k, NULL, 'intensity.max_poi_per_day', 'scalar', 0, CAST((k + {m}) % 6 AS VARCHAR) FROM u
  UNION ALL SELECT trial, usr, k, NULL, 'transport.must', 'list', o, CASE o WHEN 0 THEN concat('T', CAST((k + {m}) % 3 AS VARCHAR)) ELSE 'bus' END FROM u, range(3) r(o) WHERE k % 4 <> 1
  UNION ALL SELECT trial, usr, k, NULL, 'hotel_preference.prefer', 'list', o, concat('H', CAST(o + 1 AS VARCHAR)) FROM u, range(2) r(o) WHERE k % 3 > 0
  UNION ALL SELECT trial, usr, k, {city}, 'attractions.must_visit', 'list', 0, concat('A', CAST(k % 9 AS VARCHAR)) FROM u WHERE k % 7 > 0
  UNION ALL SELECT trial, usr, k, {city}, 'attractions.category_pref.positive', 'list', 0, concat('P', CAST((k + {m}) % 2 AS VARCHAR)) FROM u WHERE k % 7 > 0
  UNION ALL SELECT trial, usr, k, {city}, 'food.must_eat', 'list', 0, concat('F', CAST(k % 4 AS VARCHAR)) FROM u WHERE k % 7 > 0 AND k % 5 <> 2
  UNION ALL SELECT trial, usr, k, {city}, 'food.avoid_eat', 'list', o, concat('F', CAST(o + 1 AS VARCHAR)) FROM u, range(2) r(o) WHERE k % 7 > 0 AND k % 5 <> 2)"""


def _leaves(spark, sf_dir: str, other: int = 0) -> DataFrame:
    tree = P.nodes(P.user_slots(snapshot(spark, sf_dir, other)), "pref", P.WHO)
    return P.items(tree, P.WHO)


@query(f"WITH {_USERS}, {_items_sql('it', 0)} SELECT trial, usr, city, field, kind, CAST(ord AS INT) AS ord, value FROM it")
def q_leaves(spark, sf_dir):
    """Sections that are no objects, empty and null lists, wrapped and plain users."""
    return _leaves(spark, sf_dir)


_OTHER = 7


@query(f"""WITH {_USERS}, {_items_sql('ref', 0)}, {_items_sql('agt', _OTHER)}, rl AS (SELECT trial, usr, coalesce(city, '') AS c, field, list(value ORDER BY ord) AS r FROM ref WHERE kind = 'list' GROUP BY ALL),
al AS (SELECT trial, usr, coalesce(city, '') AS c, field, list(value ORDER BY ord) AS a FROM agt WHERE kind = 'list' GROUP BY ALL),
m AS (SELECT trial, len(list_filter(r, lambda x: list_contains(a, x))) AS collected, len(r) AS possible, len(list_filter(a, lambda x: list_contains(r, x))) AS correct, len(a) AS agent_total FROM rl JOIN al USING (trial, usr, c, field)
  UNION ALL SELECT ref.trial, CAST(ref.value = agt.value AS INT), 1, CAST(ref.value = agt.value AS INT), 1 FROM ref JOIN agt USING (usr, field) WHERE ref.kind = 'scalar' AND ref.value <> '0'),
g AS (SELECT trial, sum(collected) / sum(possible) AS recall, sum(correct) / sum(agent_total) AS precision FROM m GROUP BY trial)
SELECT trial, recall, precision, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM g""")
def q_complete(spark, sf_dir):
    """E1 to E4, end to end: an agent's snapshot against the reference, by trial."""
    agent, ref = _leaves(spark, sf_dir, _OTHER), _leaves(spark, sf_dir)
    counts = ["trial", "collected", "possible", "correct", "agent_total"]
    lists = S.compare_lists(P.paired_lists(agent, ref, P.WHO), "agent", "ref").select(counts)
    scalars = S.compare_scalars(P.paired_scalars(agent, ref, P.WHO), "agent", "ref").select(counts)
    return S.prf(lists.unionByName(scalars), "trial")


_PATHS = ("global_constraints.avg_budget", "hotel_preference.prefer", "global_constraints.transport", "transport.transport.must", "C{}.food.must_eat", "nowhere.at.all", "global_constraints_constraints.transport", "transport.extra.deep")
_VALUES = ("{}", '["HX","HY"]', '"walk"', '["tram"]', '["FX"]', "1", '{"must":["T9"],"extra":{}}', "5")


def edits(spark, sf_dir: str) -> DataFrame:
    """trial, usr, seq, path, value VARIANT: a customer's orders as edits in order, of eight kinds."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda xs, by: F.replace(F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit("{}"), by.cast("string"))
    value = F.when(F.col("o_orderkey") % 8 == 6, _VALUES[6]).otherwise(pick(_VALUES, F.col("o_orderkey") % 1000))
    return o.select(
        F.expr("CAST(floor(c_custkey / 3) AS BIGINT)").alias("trial"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("usr"), F.col("o_orderkey").alias("seq"),
        pick(_PATHS, F.col("c_nationkey")).alias("path"), F.try_parse_json(value).alias("value"),
    )


_EDITS = f"""{_USERS}, e AS (SELECT u.*, o_orderkey AS seq, o_orderkey % 8 AS kind FROM orders JOIN u ON k = o_custkey),
z AS (SELECT *, CASE kind WHEN 1 THEN k % 3 > 0 WHEN 3 THEN k % 4 <> 1 WHEN 4 THEN k % 7 > 0 AND k % 5 <> 2 WHEN 5 THEN false WHEN 7 THEN false ELSE true END AS ok0 FROM e),
a AS (SELECT usr, min(seq) AS one, arg_min(kind, seq) AS kind1 FROM z WHERE ok0 GROUP BY usr),
y AS (SELECT z.*, one, CASE WHEN one IS NULL OR seq <= one THEN ok0 WHEN kind = 3 AND kind1 IN (2, 6) THEN kind1 = 6 WHEN kind = 7 THEN kind1 = 6 ELSE ok0 END AS ok1 FROM z LEFT JOIN a USING (usr)),
b AS (SELECT usr, min(seq) AS two FROM y WHERE ok1 AND seq > one GROUP BY usr),
att AS (SELECT y.*, two FROM y LEFT JOIN b USING (usr) WHERE two IS NULL OR seq <= two)"""


@query(f"""WITH {_EDITS} SELECT trial, usr, seq, ok1 AS applied, CASE kind WHEN 0 THEN 'global_constraints.avg_budget' WHEN 1 THEN CASE WHEN ok1 THEN 'global_constraints.hotel_preference.prefer' ELSE 'hotel_preference.prefer' END
  WHEN 2 THEN 'global_constraints.transport' WHEN 3 THEN CASE WHEN ok1 THEN 'global_constraints.transport.must' ELSE 'transport.must' END
  WHEN 4 THEN concat(CASE WHEN ok1 THEN 'city_specific_preferences.' ELSE '' END, 'C', CAST(n AS VARCHAR), '.food.must_eat') WHEN 5 THEN 'nowhere.at.all' WHEN 6 THEN 'global_constraints.transport'
  ELSE CASE WHEN ok1 THEN 'global_constraints.transport.extra.deep' ELSE 'transport.extra.deep' END END AS field_path FROM att""")
def q_attempts(spark, sf_dir):
    """Which edits count: whether a path exists may depend on the edit before; two a user, fallback below the sections."""
    return P.effective(P.user_slots(snapshot(spark, sf_dir)), edits(spark, sf_dir))[1]


@query(f"""WITH {_EDITS}, {_items_sql('it', 0)}, t AS (SELECT * FROM att WHERE ok1),
f AS (SELECT usr, max(CASE WHEN kind = 0 THEN seq END) AS b, max(CASE WHEN kind = 1 THEN seq END) AS h, max(CASE WHEN kind = 4 THEN seq END) AS f, arg_max(kind, CASE WHEN kind IN (2, 3, 6) THEN seq END) AS tk FROM t GROUP BY usr)
SELECT trial, usr, city, field, kind, CAST(ord AS INT) AS ord, value FROM it LEFT JOIN f USING (usr) WHERE NOT (field = 'avg_budget' AND b IS NOT NULL OR field = 'hotel_preference.prefer' AND h IS NOT NULL OR field = 'food.must_eat' AND f IS NOT NULL OR field LIKE 'transport%' AND tk IS NOT NULL)
UNION ALL SELECT trial, usr, NULL, 'avg_budget', 'scalar', 0, CAST(b % 1000 AS VARCHAR) FROM f JOIN u USING (usr) WHERE b IS NOT NULL
UNION ALL SELECT trial, usr, NULL, 'hotel_preference.prefer', 'list', o, CASE o WHEN 0 THEN 'HX' ELSE 'HY' END FROM f JOIN u USING (usr), range(2) r(o) WHERE h IS NOT NULL
UNION ALL SELECT trial, usr, concat('C', CAST(n AS VARCHAR)), 'food.must_eat', 'list', 0, 'FX' FROM f JOIN u USING (usr) WHERE f IS NOT NULL
UNION ALL SELECT trial, usr, NULL, 'transport.must', 'list', 0, CASE tk WHEN 3 THEN 'tram' ELSE 'T9' END FROM f JOIN u USING (usr) WHERE tk IN (3, 6)""")
def q_effective(spark, sf_dir):
    """The leaves after the edits; a section may be replaced by a text or by another object."""
    tree, _ = P.effective(P.user_slots(snapshot(spark, sf_dir)), edits(spark, sf_dir))
    return P.items(tree, P.WHO)
