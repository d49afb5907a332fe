"""Preferences and their edits against dictionaries that are changed step by step."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tripfold.functions import jsonx
from tripfold.operators import preferences as P
from tripfold.operators import scoring as S

KEYS = ["global_constraints", "city_specific_preferences", "transport", "hotel_preference", "food", "must", "prefer", "X市", "avg_budget"]


def rand_value(rng, depth):
    if depth and rng.random() < 0.7:
        return {k: rand_value(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(0, 4))}
    return rng.choice([1, "text", None, [], ["a", "b"], {}, True])


def put(tree, path, value):
    at = tree
    for k in path[:-1]:
        if not isinstance(at, dict) or k not in at:
            return False
        at = at[k]
    if not isinstance(at, dict):
        return False
    at[path[-1]] = value
    return True


def brute(pref, markers, most=2):
    tree, log, n = copy.deepcopy(pref), [], 0
    for seq, path, value in markers:
        if n >= most:
            break
        for tried in (path, *(x + path for x in ("global_constraints.", "city_specific_preferences.") if not path.startswith(x))):
            if put(tree, tried.split("."), copy.deepcopy(value)):
                log.append((seq, tried, True))
                n += 1
                break
        else:
            log.append((seq, path, False))
    return tree, log


def leaves(v, path=()):
    if isinstance(v, dict) and v:
        return [x for k, w in v.items() for x in leaves(w, (*path, k))]
    return [(path, json.dumps(v, sort_keys=True, separators=(",", ":")))]


@pytest.fixture(scope="module")
def edited(spark):
    rng = random.Random(2)
    cases = []
    for k in range(150):
        pref = rand_value(rng, 4) if k % 9 else rng.choice([None, 3, [], {}])
        markers = []
        for seq in range(rng.randrange(0, 7)):
            path = ".".join(rng.choice(KEYS) for _ in range(rng.randrange(1, 5)))
            parts = path.split(".")
            path = ".".join(p for i, p in enumerate(parts) if i == 0 or p != parts[i - 1])  # stutters are mended elsewhere
            markers.append((seq * 3, path, rand_value(rng, 2)))
        cases.append((pref, markers))
    prefs = spark.createDataFrame([(k // 3, f"U{k}", json.dumps(p)) for k, (p, _) in enumerate(cases)], "trial long, usr string, pref string").select("trial", "usr", F.parse_json("pref").alias("pref"))
    rows = [(k // 3, f"U{k}", s, p, json.dumps(v)) for k, (_, m) in enumerate(cases) for s, p, v in m] + [(0, "nobody", 0, "avg_budget", "1"), (0, "U0", 99, None, None)]
    marks = spark.createDataFrame(rows, "trial long, usr string, seq int, path string, value string").select("trial", "usr", "seq", "path", F.parse_json("value").alias("value"))
    return cases, P.effective(prefs, marks)


def test_effective_leaves(edited):
    cases, (tree, _) = edited
    got: dict = {}
    for r in P.leaf_values(tree, P.WHO).select("usr", "path", F.to_json("value").alias("v")).collect():
        got.setdefault(r["usr"], []).append((tuple(r["path"]), r["v"]))
    changed = 0
    for k, (pref, markers) in enumerate(cases):
        want, _ = brute(pref, markers)
        changed += want != pref
        assert sorted(got[f"U{k}"]) == sorted(leaves(want)), (pref, markers)
    assert changed > 40


def test_log_of_attempts(edited):
    cases, (_, log) = edited
    got = sorted((r["usr"], r["seq"], r["field_path"], r["applied"]) for r in log.collect())
    want = sorted((f"U{k}", *x) for k, (p, m) in enumerate(cases) for x in brute(p, m)[1])
    assert got == want and sum(not x[3] for x in want) > 20


def test_an_edit_may_open_or_close_the_way_for_the_next(spark):
    pref = {"global_constraints": {"transport": {"must": ["x"]}, "hotel_preference": None}}
    prefs = spark.createDataFrame([(1, u, json.dumps(pref)) for u in "abc"], "trial long, usr string, pref string").select("trial", "usr", F.parse_json("pref").alias("pref"))
    rows = [
        ("a", 1, "transport", '"walk"'), ("a", 2, "global_constraints.transport", '"walk"'), ("a", 3, "transport.must", "[]"), ("a", 4, "global_constraints.avg_budget", "5"),
        ("b", 1, "hotel_preference.prefer", '["h"]'), ("b", 2, "global_constraints.hotel_preference", '{"prefer":[]}'), ("b", 3, "hotel_preference.prefer", '["h"]'), ("b", 4, "avg_budget", "1"),
        ("c", 1, "global_constraints_constraints.transport.transport.must", '["y"]'),
    ]
    marks = spark.createDataFrame([(1, *r) for r in rows], "trial long, usr string, seq int, path string, value string").withColumn("value", F.parse_json("value"))
    tree, log = P.effective(prefs, marks)
    assert sorted(tuple(r)[1:] for r in log.select("trial", "usr", "seq", "field_path", "applied").collect()) == [
        ("a", 1, "transport", True), ("a", 2, "global_constraints.transport", True),
        ("b", 1, "hotel_preference.prefer", False), ("b", 2, "global_constraints.hotel_preference", True), ("b", 3, "global_constraints.hotel_preference.prefer", True),
        ("c", 1, "global_constraints.transport.must", True),
    ]
    got = {(r["usr"], r["field"], r["ord"]): r["value"] for r in P.items(tree, P.WHO).collect()}
    assert got == {("b", "transport.must", 0): "x", ("b", "hotel_preference.prefer", 0): "h", ("c", "transport.must", 0): "y"}


def test_items_of_odd_sections(spark):
    prefs = {
        "u": {"preference": {"global_constraints": {"avg_budget": 0, "transport": [], "intensity": {"max_poi_per_day": 3.5, "max_active_hours": None}}, "city_specific_preferences": {"X": {"attractions": {"must_visit": ["a", None, 3], "category_pref": "no"}, "food": {"must_eat": {}}}, "Y": 7}}},
        "v": {"global_constraints": "none"}, "w": None, "x": {"preference": None},
    }
    df = spark.createDataFrame([(1, json.dumps(prefs)), (2, "[]"), (3, None)], "trial long, p string").select("trial", jsonx.strict_variant("p").alias("prefs"))
    got = sorted((r["usr"], r["city"], r["field"], r["ord"], r["value"]) for r in P.items(P.nodes(P.user_slots(df), "pref", P.WHO), P.WHO).collect() if r["city"]) + sorted((r["field"], r["value"]) for r in P.items(P.nodes(P.user_slots(df), "pref", P.WHO), P.WHO).collect() if not r["city"])
    assert got == [("u", "X", "attractions.must_visit", 0, "a"), ("u", "X", "attractions.must_visit", 1, None), ("u", "X", "attractions.must_visit", 2, "3"), ("avg_budget", "0"), ("intensity.max_poi_per_day", "3.5")]


def test_pairs_of_snapshots(spark):
    rows = lambda *x: spark.createDataFrame([(1, "u", *r) for r in x], "trial long, usr string, city string, field string, kind string, ord int, value string")
    ref = rows((None, "transport.must", "list", 0, "a"), (None, "transport.must", "list", 1, "b"), (None, "transport.must", "list", 2, "b"), (None, "avg_budget", "scalar", 0, "100"))
    agent = rows((None, "transport.must", "list", 0, "b"), (None, "transport.must", "list", 1, "c"), ("X", "food.must_eat", "list", 0, "z"))
    counts = ["collected", "possible", "correct", "agent_total"]
    both = S.compare_lists(P.paired_lists(agent, ref, P.WHO), "agent", "ref").select("trial", *counts).unionByName(S.compare_scalars(P.paired_scalars(agent, ref, P.WHO), "agent", "ref").select("trial", *counts))
    r = S.prf(both, "trial").first()
    assert (r["recall"], round(r["precision"], 9), round(r["f1"], 9)) == (0.5, round(1 / 3, 9), 0.4)
