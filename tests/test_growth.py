"""Steps whose work must grow no faster than their input: what they may not do, whatever the size of the tables."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tripfold.operators import lookups
from tripfold.operators import plan_scores as S
from tripfold.operators import preferences as P
from tripfold.plans import planned, planscores


@pytest.fixture(scope="module")
def edited(spark):
    pref = {"global_constraints": {"avg_budget": 1, "transport": {"must": ["x"]}}, "city_specific_preferences": {"X": {"food": {"must_eat": ["f"]}}}}
    prefs = spark.createDataFrame([(1, u, json.dumps(pref)) for u in "ab"], "trial long, usr string, p string").select("trial", "usr", F.parse_json("p").alias("pref"))
    marks = spark.createDataFrame([(1, "a", k, "transport.must", "[]") for k in range(5)], "trial long, usr string, seq int, path string, value string").withColumn("value", F.parse_json("value"))
    return prefs, marks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edits_are_met_without_tables_between_the_rounds(spark, edited):
    spark.sparkContext.setJobGroup("edits", "")
    try:
        _, log = P.effective(*edited)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("edits")  # nothing is written, so no marker is shuffled and stored again in each round
    assert "Broadcast" not in plan(log) and "Generate" not in plan(log)  # no marker is unfolded to the paths that it tries
    assert log.where("applied").count() == 2


def test_preferences_are_opened_once(edited):
    assert plan(P.nodes(edited[0], "pref", P.WHO)).count("Generate ") == 1
    tree, _ = P.effective(*edited)
    shown = plan(P.items(tree, P.WHO))
    assert "Union" not in shown and "Broadcast" not in shown


@pytest.fixture(scope="module")
def scored(spark):
    """Tables that Spark takes to be small enough for broadcasts."""
    few = lambda e: spark.range(3).selectExpr("id AS trial", *e)
    users = few(["'u' AS usr"])
    wishes = few(["'u' AS usr", "'C' AS city", "'attractions.must_visit' AS field", "'list' AS kind", "0 AS ord", "'L' AS value"])
    acts = few(["0 AS day_ix", "1L AS day", "0 AS seg_ix", "0 AS act_ix", "'C' AS city", "'attraction' AS typ", "'L1' AS location", "CAST(NULL AS STRING) AS `to`", "'9:00' AS start_time", "540 AS st", "600 AS en", "'1' AS cost", "array('u') AS who"])
    segments = few(["'intercity' AS kind", "'M' AS transport_mode", "'1' AS cost"])
    return users, wishes, acts, segments


def test_named_places_and_conflicts_broadcast_nothing(spark, scored):
    users, wishes, acts, _ = scored
    by_name, taken = S.named(S.activity_users(acts, users), wishes)
    clean = S.scorable(acts, users)
    assert [r["score"] for r in by_name.collect()] == [2, 2, 2]
    for df in (by_name, taken, S.activity_users(acts, users), clean):
        assert "Broadcast" not in plan(df)
    assert "Broadcast" not in plan(planned.plan_texts(spark, SF))


def test_a_catalogue_is_grouped_before_it_is_asked(spark):
    poi = spark.range(9).selectExpr("'C' AS city", "concat('L', id % 2) AS name", "9 - id AS ord")
    found = lookups.match_places(spark.range(1).selectExpr("'C' AS city", "'L1' AS place"), poi)
    assert [tuple(r) for r in found.collect()] == [("C", "L1", "L1", 2)]
    assert "partial_min(ord" in plan(found).split("BroadcastExchange")[-1] or "partial_min(ord" in plan(found).split("Join")[-1]  # below the join, not above it


def test_scores_of_users_take_what_was_written(spark, scored):
    users, wishes, acts, segments = scored
    scores = planscores.Scored(spark, SF).scores()
    assert "Window" not in plan(scores) and "Generate inline" not in plan(scores)  # conflicts and wishes aren't worked out again by each score
    taking = S.activity_users(acts, users)
    for df in (S.pace(taking, wishes), S.modes(segments, wishes), S.spending(segments, acts, taking, users), S.budget(S.spending(segments, acts, taking, users), wishes)):
        assert "Broadcast" not in plan(df)


def test_utility_takes_each_users_sums_once(spark, scored):
    users, wishes, _, _ = scored
    each = users.withColumn("total", users["trial"])
    assert "Broadcast" not in plan(S.utility(each, wishes.select("trial", "usr"), users.withColumn("penalty", users["trial"])))
    shown = plan(planscores.q_planutility(spark, SF))
    assert "attractions.must_visit" not in shown and "Generate" not in shown.split("Window")[0]
