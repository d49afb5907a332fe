"""Queries of the rollup family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripfold.operators import rollup as R
from tripfold.plans.adapters import CALLS, HISTORY, TRIALS, calls, history, table, trials

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_MEANS = f"""WITH {TRIALS}, m AS (SELECT task,
  CAST(sum(CASE WHEN NOT coalesce(failed, false) THEN score END) AS DOUBLE) / count(CASE WHEN NOT coalesce(failed, false) THEN score END) AS avg_score,
  count(CASE WHEN NOT coalesce(failed, false) THEN score END) AS valid, coalesce(bool_or(failed), false) AS any_failed
  FROM trl GROUP BY task)"""


@query(_MEANS + " SELECT task, avg_score, valid, any_failed FROM m")
def q_trials(spark, sf_dir):
    return R.trial_means(trials(spark, sf_dir), "task", "score", "failed")


_GROUPED = _MEANS + """, t AS (SELECT m.*, coalesce(o_orderpriority, 'unknown') AS difficulty FROM m
  LEFT JOIN (SELECT o_orderkey, {0} AS o_orderpriority FROM orders) o ON task = o_orderkey)
SELECT coalesce(difficulty, 'overall') AS grp, CAST(sum(CAST(floor(coalesce(avg_score, 0) * 1000000) AS BIGINT)) AS DOUBLE) / 1000000.0::DOUBLE / count(*) AS avg_metric,
  min(coalesce(avg_score, 0)) AS lo, max(coalesce(avg_score, 0)) AS hi, count(*) AS tasks, count(avg_score) AS valid
FROM t GROUP BY GROUPING SETS ((), (difficulty))"""


@query(_GROUPED.format("o_orderpriority"))
def q_gsets(spark, sf_dir):
    """Average score per task over its trials, none counting 0, overall and by difficulty."""
    rows = trials(spark, sf_dir)
    means = R.trial_means(rows, "task", "score", "failed")
    return R.by_group(R.with_difficulty(means, rows, "task", "difficulty"), "difficulty", "avg_score")


@query(_GROUPED.format("CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END"))
def q_difficulty(spark, sf_dir):
    """As q_gsets, with one difficulty missing from the lookup."""
    rows = trials(spark, sf_dir)
    known = rows.withColumn("difficulty", F.when(~F.col("difficulty").startswith("1"), F.col("difficulty")))
    return R.by_group(R.with_difficulty(R.trial_means(rows, "task", "score", "failed"), known, "task", "difficulty"), "difficulty", "avg_score")


@query(f"""WITH {TRIALS} SELECT task, coalesce(CAST(sum(score) AS DOUBLE) / count(score), 0) AS judge, count(score) = 0 AS crashed FROM trl GROUP BY task""")
def q_zerofill(spark, sf_dir):
    """Tasks without a judged trial count 0."""
    return trials(spark, sf_dir).groupBy("task").agg(F.coalesce(R.mean(F.col("score")), F.lit(0.0)).alias("judge"), (F.count("score") == 0).alias("crashed"))


@query("SELECT o_orderpriority AS difficulty, count(*) AS trials FROM orders, range(3) GROUP BY o_orderpriority")
def q_cross(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("difficulty"))
    return R.expand(tasks, 3).groupBy("difficulty").agg(F.count("*").alias("trials"))


_RESULTS = """res AS (SELECT l_orderkey AS task, CAST(l_linenumber % 3 AS INT) AS trial, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS success,
  CASE l_suppkey % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'connection_error' WHEN 2 THEN 'done' END AS reason, l_partkey AS part, l_linenumber AS line FROM lineitem),
may AS (SELECT *, NOT coalesce(success, false) AND coalesce(reason IN ('rate_limit', 'connection_error'), false) AS again FROM res)"""


def _results(spark, sf_dir):
    flag, m = F.col("l_returnflag"), F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task"), (F.col("l_linenumber") % 3).cast("int").alias("trial"), F.when(flag == "A", True).when(flag == "R", False).alias("success"),
        F.when(m == 0, "rate_limit").when(m == 1, "connection_error").when(m == 2, "done").alias("reason"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
    )


@query(f"""WITH {_RESULTS}, w AS (SELECT o_orderkey AS task, CAST(range AS INT) AS trial FROM orders, range(3))
SELECT task, trial FROM w WHERE NOT EXISTS (SELECT 1 FROM may WHERE may.task = w.task AND may.trial = w.trial AND NOT again)""")
def q_resume(spark, sf_dir):
    """Three trials of each task, less those that succeeded or failed for good. A trial may have several results."""
    wanted = R.expand(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")), 3)
    return R.resumed(wanted, _results(spark, sf_dir), ["task", "trial"])


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 25 WHEN '5-LOW' THEN 15 ELSE 20 END AS max_turn, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '5-LOW' THEN 3 ELSE 4 END AS interval FROM orders")
def q_settings(spark, sf_dir):
    """Urgent orders are hard, low ones easy, the middle ones of no known difficulty."""
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "hard").when(p == "5-LOW", "easy").when(p == "3-MEDIUM", "medium")
    return R.with_settings(table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("k")), "k").drop("k")


@query(f"""WITH {_RESULTS} SELECT task, trial, part, line FROM may m WHERE NOT EXISTS (SELECT 1 FROM may x WHERE x.task = m.task AND x.trial = m.trial AND x.again)""")
def q_purge(spark, sf_dir):
    """Successful runs with such a reason stay; all rows of a trial that is run again go."""
    return R.purge_retryable(_results(spark, sf_dir), ["task", "trial"]).select("task", "trial", "part", "line")


@query("""SELECT o_orderkey AS task, coalesce(d, 'unknown') AS difficulty FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS d FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def q_lastline(spark, sf_dir):
    """Tasks that are listed several times; the last line holds."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("d"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("line"))
    return R.with_difficulty(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")), lines, "task", "d", "line")


@query("""WITH s AS (SELECT l_orderkey AS trial, concat('d', CAST(l_linenumber % 5 AS VARCHAR)) AS dim, CASE WHEN l_partkey % 6 > 0 THEN CAST(l_partkey % 5 + 1 AS DOUBLE) END AS raw, CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 5 * 25 AS DOUBLE) END AS norm,
  CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey % 5 * 20 AS DOUBLE) END AS penalised, CAST(NULL AS DOUBLE) AS nothing, CASE WHEN l_linenumber <> 4 THEN CAST(l_suppkey % 101 AS DOUBLE) END AS final FROM lineitem),
l AS (UNPIVOT (SELECT trial, dim, coalesce(raw, -1) AS raw, coalesce(norm, -1) AS norm, coalesce(penalised, -1) AS penalised, coalesce(final, -1) AS final FROM s) ON raw, norm, penalised, final INTO NAME family VALUE x),
v AS (SELECT trial, dim, family, nullif(x, -1) AS x FROM l), d AS (SELECT family, dim, coalesce(sum(x) / count(x), 0) AS mean FROM v GROUP BY ALL),
t AS (SELECT family, trial, sum(x) / count(x) AS m FROM v WHERE family <> 'final' GROUP BY ALL)
SELECT family, dim, round(mean, 6) AS mean FROM d UNION ALL SELECT family, 'overall', round(coalesce(sum(m) / count(m), 0), 6) FROM t GROUP BY family UNION ALL SELECT family, 'overall', round(sum(mean) / count(mean), 6) FROM d WHERE family = 'final' GROUP BY family""")
def q_families(spark, sf_dir):
    """Raw, normalised, penalised and final scores; a dimension without any final score counts 0."""
    l = table(spark, sf_dir, "lineitem")
    p, flag = F.col("l_partkey") % 5, F.col("l_returnflag")
    s = l.select(
        F.col("l_orderkey").alias("trial"), F.concat(F.lit("d"), (F.col("l_linenumber") % 5).cast("string")).alias("dim"), F.when(F.col("l_partkey") % 6 > 0, p + 1).alias("raw"), F.when(flag != "R", p * 25).alias("norm"),
        F.when(flag == "A", p * 20).alias("penalised"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey") % 101).alias("final"),
    )
    return R.families(s, "trial").withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'run_failed' WHEN o_custkey % 5 = 0 THEN 'no_reference' WHEN o_orderkey % 3 = 0 THEN 'no_plan' WHEN o_orderkey % 7 = 0 THEN 'plan_unreadable' END AS error FROM orders")
def q_gate(spark, sf_dir):
    """A1."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") != "F").alias("success"), F.when(F.col("o_custkey") % 5 != 0, F.lit("{}")).alias("reference"),
        (F.col("o_orderkey") % 3 != 0).alias("planned"), F.when(F.col("o_orderkey") % 7 != 0, F.lit("{}")).alias("plan"),
    )
    return R.gate(o).select("o_orderkey", "error")


_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "overall")
_SUMMARY = f"""WITH {TRIALS}, s AS (SELECT coalesce(difficulty, 'overall') AS grp, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score,
  CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS DOUBLE) AS failed FROM trl GROUP BY GROUPING SETS ((), (difficulty)))"""


def _summary(spark, sf_dir):
    return (
        trials(spark, sf_dir).groupingSets([[], ["difficulty"]], "difficulty")
        .agg(R.mean(F.col("score")).alias("avg_score"), F.count("*").alias("n"), F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failed"))
        .withColumn("grp", F.coalesce("difficulty", F.lit("overall")))
    )


@query(_SUMMARY + ", l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, grp, {m} AS value FROM s" for m in ("avg_score", "n", "failed")) + ") SELECT metric, "
       + ", ".join(f"max(CASE WHEN grp = '{g}' THEN value END) AS \"{g}\"" for g in _LEVELS) + " FROM l GROUP BY metric")
def q_pivot(spark, sf_dir):
    return R.report_table(_summary(spark, sf_dir), "grp", ["avg_score", "n", "failed"], list(_LEVELS))


@query(_SUMMARY + " SELECT grp, ((1 - failed / n) * 100 + avg_score / 1000 + failed / n * 100 + n / 1000) / 4 AS composite FROM s")
def q_composite(spark, sf_dir):
    s = _summary(spark, sf_dir).select("grp", (1 - F.col("failed").cast("double") / F.col("n")).alias("a"), (F.col("avg_score") / 1000).alias("b"),
                                       (F.col("failed").cast("double") / F.col("n")).alias("c"), (F.col("n").cast("double") / 1000).alias("e"))
    return R.composite(s, "a", "b", "c", "e").select("grp", "composite")


@query("SELECT event_type AS reason, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type")
def q_shares(spark, sf_dir):
    return R.shares(table(spark, sf_dir, "events").withColumnRenamed("event_type", "reason"), "reason")


@query(f"""WITH {CALLS}, r AS (SELECT trial, CAST(sum(CASE WHEN tool = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM cal GROUP BY trial),
b(ord, bucket) AS (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(R.RATE_BUCKETS))})
SELECT ord, bucket, (SELECT count(*) FROM r WHERE ord = CASE WHEN rate <= 0 THEN 0 WHEN rate <= .25 THEN 1 WHEN rate <= .5 THEN 2 WHEN rate <= .75 THEN 3 ELSE 4 END) AS n FROM b""")
def q_hist5(spark, sf_dir):
    rate = calls(spark, sf_dir).groupBy("trial").agg((F.sum(F.when(F.col("tool") == "error", 1).otherwise(0)).cast("double") / F.count("*")).alias("rate"))
    return R.rate_histogram(rate, "rate")


@query(f"""WITH {CALLS}, s AS (SELECT trial, count(*) AS calls, sum(CASE WHEN early THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN tool = 'error' THEN 1 ELSE 0 END) AS errors FROM cal GROUP BY trial)
SELECT count(*) AS runs, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(calls) AS DOUBLE) / count(*) AS calls_per_run, CAST(sum(hits) AS DOUBLE) / nullif(sum(calls), 0) AS hit_rate,
  CAST(sum(errors) AS DOUBLE) / nullif(sum(calls), 0) AS error_rate FROM s""")
def q_toolstats(spark, sf_dir):
    """Counters per trial, then totals, averages and rates."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = calls(spark, sf_dir).groupBy("trial").agg(F.count("*").alias("calls"), one(F.col("early")).alias("hits"), one(F.col("tool") == "error").alias("errors"))
    t = s.agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("calls", "hits", "errors")])
    rate = lambda a: F.try_divide(F.col(a).cast("double"), F.col("calls"))
    return t.select("*", (F.col("calls").cast("double") / F.col("runs")).alias("calls_per_run"), rate("hits").alias("hit_rate"), rate("errors").alias("error_rate"))


@query(f"""WITH {HISTORY} SELECT trial, seq, CASE WHEN content LIKE '%maximum context length%' OR content LIKE '%context_length_exceeded%' THEN 'context_overflow'
  WHEN content LIKE '%Connection error%' OR lower(content) LIKE '%timeout%' THEN 'connection_error'
  WHEN lower(content) LIKE '%rate limit%' OR content LIKE '%429%' THEN 'rate_limit' ELSE 'runtime_error' END AS cls
  FROM (SELECT trial, seq, concat(content, CASE seq % 5 WHEN 0 THEN ' context_length_exceeded' WHEN 1 THEN ' TimeOut' WHEN 2 THEN ' Rate Limit' WHEN 3 THEN ' 429' ELSE '' END) AS content FROM his)""")
def q_case(spark, sf_dir):
    """C25 on messages with an error text put at their end."""
    from tripfold.functions.text import classify_error

    m = F.col("seq") % 5
    tail = F.when(m == 0, " context_length_exceeded").when(m == 1, " TimeOut").when(m == 2, " Rate Limit").when(m == 3, " 429").otherwise("")
    return history(spark, sf_dir).select("trial", "seq", classify_error(F.concat("content", tail)).alias("cls"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100")
def q_limit(spark, sf_dir):
    """The first rows by index."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(100)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type AS tool, count(*) AS missed FROM events GROUP BY 1, 2")
def q_window(spark, sf_dir):
    """X3 as a batch: missed calls of each tool by hour."""
    from tripfold.streaming.jobs import missed_per_window

    return missed_per_window(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour").select(F.col("start").alias("hour"), F.col("event_type").alias("tool"), "missed")


@query(f"""WITH {TRIALS}, m AS (SELECT task, difficulty, coalesce(CAST(sum(score) AS DOUBLE) / count(score), 0) AS judge FROM trl GROUP BY task, difficulty)
SELECT coalesce(difficulty, 'overall') AS grp, CAST(sum(CAST(floor(judge * 1000000) AS BIGINT)) AS DOUBLE) / 1000000.0::DOUBLE / count(*) AS judge, count(*) AS tasks FROM m GROUP BY GROUPING SETS ((), (difficulty))""")
def q_judgegroup(spark, sf_dir):
    """The mean of a task's judged trials first, 0 without any, then by difficulty and overall."""
    m = trials(spark, sf_dir).groupBy("task", "difficulty").agg(F.coalesce(R.mean(F.col("score")), F.lit(0.0)).alias("judge"))
    g = R.by_group(m, "difficulty", "judge")
    return g.select("grp", F.col("avg_metric").alias("judge"), "tasks")


@query(f"""WITH {TRIALS} SELECT task, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score, string_agg(CAST(trial AS VARCHAR), ',' ORDER BY trial) AS trials FROM trl WHERE trial IS NOT NULL GROUP BY task""")
def q_trialdetail(spark, sf_dir):
    """A3: the mean with the trials behind it; rounding is left to what shows it."""
    t = trials(spark, sf_dir).where("trial is not null")
    detail = F.array_join(F.transform(F.array_sort(F.collect_list("trial")), lambda x: x.cast("string")), ",")
    return t.groupBy("task").agg(R.mean(F.col("score")).alias("avg_score"), detail.alias("trials"))
