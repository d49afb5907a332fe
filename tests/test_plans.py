"""Plan operators against rules written out step by step, over random plans, and the golden cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tripfold.functions import jsonx
from tripfold.operators import plans as P

USERS = ["U0", "U1", "U2"]
CITIES = ["A", "A市", "B", "C县", "", None]


def rand_plan(rng):
    clock = lambda: rng.choice([f"{rng.randrange(24)}:{rng.randrange(60):02d}"] * 9 + ["24:00", "x", "", None])

    def act():
        a = {"type": rng.choice(["attraction", "food", "hotel", "intracity_transport", "rest", "photo"]), "start_time": clock(), "end_time": clock()}
        for k in ("location", "from", "to"):
            if rng.random() < 0.85:
                a[k] = rng.choice(["p", "q", "r", "", None])
        if rng.random() < 0.8:
            a["participants"] = rng.choice([[], ["All"], ["U0"], ["U1", "U2"], ["U2", "U1"], ["U0", "U0"], ["U0", "Bob"], None, ["U0", "U1", "U2"]])
        if rng.random() < 0.5:
            a["avg_cost"] = rng.choice([1, "2", None])
        return a

    def segment():
        if rng.random() < 0.3:
            return {"type": "intercity_transport", "from_city": "A", "start_time": clock(), "end_time": clock()} | ({"to_city": rng.choice(CITIES)} if rng.random() < 0.9 else {})
        s = {"city": rng.choice(CITIES)} if rng.random() < 0.85 else {}
        if rng.random() < 0.9:
            s["activities"] = rng.choice([None, [], *[[act() for _ in range(rng.randrange(1, 6))] for _ in range(5)]])
        return s

    def day(i):
        return {"day": i + 1, "city_segments": rng.choice([None, [], *[[segment() for _ in range(rng.randrange(1, 5))] for _ in range(6)]])}

    return rng.choice([{"days": None}, {}, {"days": []}, *[{"days": [day(i) for i in range(rng.randrange(1, 5))]} for _ in range(9)]])


def minutes(t):
    m = re.fullmatch(r"(2[0-3]|[01]\d|\d):([0-5]\d|\d)", t or "")
    return int(m[1]) * 60 + int(m[2]) if m else None


def blocks(day):
    return [(i, s, [] if s.get("type") == "intercity_transport" else s.get("activities") or []) for i, s in enumerate(day.get("city_segments") or [])]


def is_leg(s):
    return s.get("type") == "intercity_transport"


def who(a):
    return USERS if not a.get("participants") or a["participants"] == ["All"] else a["participants"]


def starts(a, end=False):
    return a.get("location") if a["type"] in P.PLACED else a.get("to" if end else "from") if a["type"] == "intracity_transport" else None


def brute_transfers(plan):
    out = []
    for d, day in enumerate(plan.get("days") or []):
        at: dict = {}
        for i, s, acts in blocks(day):
            if is_leg(s):
                at |= {u: "hub!" for u in USERS}
            for j, a in enumerate(acts):
                for n, u in enumerate(who(a)):
                    here, to = at.get(u), starts(a)
                    if a["type"] == "rest":
                        continue
                    if here == "hub!":
                        if a["type"] != "intracity_transport":
                            out.append((d, i, j, n, u, "missing_intracity_transport", None, to))
                    elif here is not None and to is not None and here != to:
                        out.append((d, i, j, n, u, "intracity_transport_origin_mismatch" if a["type"] == "intracity_transport" else "missing_intracity_transport", here, to))
                    end = starts(a, True)
                    if end is not None and not (a["type"] == "hotel" and end == ""):
                        at[u] = end
    return out


def brute_backwards(plan):
    out = []
    for d, day in enumerate(plan.get("days") or []):
        for u in USERS:
            clock = None
            for i, s, acts in blocks(day):
                rows = [(-1, s, "intercity_transport")] if is_leg(s) else [(j, a, a["type"]) for j, a in enumerate(acts) if u in who(a)]
                for j, a, typ in rows:
                    st, en = minutes(a.get("start_time")), minutes(a.get("end_time"))
                    if clock is not None and st is not None and st < clock:
                        out.append((d, u, i, j, clock))
                    if typ != "hotel" and en is not None and (st is None or en >= st):
                        clock = en
    return out


def key(c):
    return c if not c else next((c[: -len(x)] for x in ("市", "区", "县", "自治州") if c.endswith(x) and len(c) > len(x)), c)


def brute_changes(plan):
    out, days = [], plan.get("days") or []
    for d, day in enumerate(days):
        was = None
        for i, s, _ in blocks(day):
            if is_leg(s):
                was = s.get("to_city") or ""
            elif "city" in s:
                if was is not None and was != s["city"] and key(was) != key(s["city"]):
                    out.append((d, i, was, s["city"]))
                was = s["city"]
    ends = [[s.get("to_city") if is_leg(s) else s["city"] for _, s, _ in blocks(day) if is_leg(s) or "city" in s] or [None] for day in days]
    for d in range(1, len(days)):
        a, b = ends[d - 1][-1], ends[d][0]
        first = blocks(days[d])[:1]
        if a and b and a != b and key(a) != key(b) and not (first and is_leg(first[0][1])):
            out.append((d, None, a, b))
    return out


def brute_nights(plan):
    out, days = [], plan.get("days") or []
    for d, day in enumerate(days[:-1]):
        full = [(s, acts) for _, s, acts in blocks(day) if "activities" in s and not is_leg(s)]
        last = full[-1][1] if full else []
        if not last:
            out.append((d, "missing_hotel"))
        elif last[-1]["type"] != "hotel":
            out.append((d, "hotel_not_last_activity" if any(a["type"] == "hotel" for _, x in full for a in x) else "missing_hotel"))
    return out


def brute_penalty(plan):
    out = []
    for d, day in enumerate(plan.get("days") or []):
        for i, _, acts in blocks(day):
            rows = [(minutes(a["start_time"]), minutes(a["end_time"]), frozenset(a["participants"])) for a in acts if a["type"] in ("attraction", "food", "rest", "intracity_transport") and a.get("participants") and a["participants"] != ["All"]]
            rows = [r for r in rows if r[0] is not None and r[1] is not None and r[1] > r[0]]
            groups: list = []
            for r in rows:
                near = [g for g in groups if any(r[0] < x[1] and x[0] < r[1] for x in g)]
                groups = [g for g in groups if g not in near] + [[r, *[x for g in near for x in g]]]
            for g in groups:
                teams = {x[2] for x in g}
                if len(teams) > 1 and sum(map(len, teams)) == len(frozenset().union(*teams)):
                    out.append((d, i, len(teams) - 1))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    plans = [rand_plan(rng) for _ in range(250)]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(plans)], "trial long, plan string").select("trial", jsonx.strict_variant("plan").alias("plan"))
    users = spark.createDataFrame([(k, u) for k in range(len(plans)) for u in USERS], "trial long, usr string")
    days = P.days(df).cache()
    segments = P.segments(days).cache()
    acts = P.activities(segments).cache()
    return plans, days, segments, acts, users, P.timeline(segments, acts, users).cache()


def same(df, columns, plans, brute):
    got = sorted(map(tuple, df.select("trial", *columns).collect()), key=repr)
    want = sorted(((k, *r) for k, p in enumerate(plans) for r in brute(p)), key=repr)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("chunk", [None, "seg_ix", "seg_ix div 2", "seg_ix * 1000 + act_ix", "seg_ix * 1000 + (act_ix + 1) div 2"])
def test_transfers(tables, chunk):
    plans, *_, line = tables
    columns = ["day_ix", "seg_ix", "act_ix", "who_ix", "usr", "issue", "from_place", "to_place"]
    same(P.transfers(line, None if chunk is None else F.expr(chunk)), columns, plans, brute_transfers)


@pytest.mark.parametrize("chunk", [None, "seg_ix", "seg_ix * 1000 + act_ix"])
def test_backwards(tables, chunk):
    plans, *_, users, line = tables
    same(P.backwards(line, users, None if chunk is None else F.expr(chunk)), ["day_ix", "usr", "seg_ix", "act_ix", "clock"], plans, brute_backwards)


def test_cities_and_nights(tables):
    plans, days, segments, acts, *_ = tables
    same(P.city_changes(days, segments), ["day_ix", "seg_ix", "from_city", "to_city"], plans, brute_changes)
    same(P.nights_without_hotel(days, segments, acts), ["day_ix", "issue"], plans, brute_nights)


def test_split_penalty(spark, tables):
    plans, _, _, acts, *_ = tables
    got = sorted(map(tuple, P.split_penalty(acts).select("trial", "day_ix", "seg_ix", "penalty").collect()))
    assert got == sorted((k, *r) for k, p in enumerate(plans) for r in brute_penalty(p))
    rng = random.Random(8)
    who = [["U0"], ["U1"], ["U2"], ["U0", "U0"], ["U1", "U2"], ["U2", "U1", "U1"], ["U0"], ["U0", "U1"], ["All"], [], ["U1"]]
    clock = lambda m: f"{m // 60}:{m % 60}"
    plans = []
    for _ in range(600):
        acts = [{"type": rng.choice(["attraction", "food", "rest", "hotel"]), "participants": rng.choice(who), "start_time": clock(st), "end_time": clock(st + rng.choice([-10, 0, 30, 45]))} for st in rng.choices(range(540, 700, 15), k=rng.randint(1, 5))]
        plans.append({"days": [{"city_segments": [{"city": "A", "activities": acts}]}]})
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(plans)], "trial long, plan string").select("trial", jsonx.strict_variant("plan").alias("plan"))
    same(P.split_penalty(P.activities(P.segments(P.days(df)))), ["day_ix", "seg_ix", "penalty"], plans, brute_penalty)


def _one(spark, *activities, days=1):
    plan = {"days": [{"day": d + 1, "city_segments": [{"city": "A", "activities": list(activities)}]} for d in range(days)]}
    days_ = P.days(spark.createDataFrame([(1, json.dumps(plan))], "trial long, plan string").select("trial", jsonx.strict_variant("plan").alias("plan")))
    segments = P.segments(days_)
    acts = P.activities(segments)
    return segments, acts, spark.createDataFrame([(1, u) for u in USERS], "trial long, usr string")


def test_two_in_the_afternoon_before_nine_is_an_issue(spark):
    segments, acts, users = _one(spark, {"type": "food", "location": "a", "start_time": "14:00", "end_time": "15:00"}, {"type": "food", "location": "b", "start_time": "9:00", "end_time": "10:00"})
    got = P.backwards(P.timeline(segments, acts, users), users).collect()
    assert sorted((r["usr"], r["act_ix"], r["clock"]) for r in got) == [(u, 1, 900) for u in USERS]


def test_people_times_and_costs(spark):
    rows = [
        {"type": "food", "participants": "U1", "start_time": "9:00", "end_time": "8:00"}, {"type": "hotel", "participants": [], "avg_cost": None}, {"type": "rest", "participants": []},
        {"type": "food", "participants": ["U1", None, "All", "X", "X"], "avg_cost": "7", "start_time": "25:00", "end_time": "9:00"}, {"type": "photo", "participants": None, "start_time": "0:0", "end_time": "0:1"},
    ]
    segments, acts, users = _one(spark, *rows)
    got = sorted((r["act_ix"], r["issue"], r["who_ix"], r["name"]) for r in P.wrong_participants(acts, users).collect())
    assert got == [(0, "not_a_list", None, None), (2, "empty", None, None), (3, "unknown", 1, None), (3, "unknown", 3, "X"), (3, "unknown", 4, "X")]
    assert sorted((r["act_ix"], r["issue"]) for r in P.time_issues(segments, acts).collect()) == [(0, "invalid_time_range"), (2, "invalid_time_format"), (3, "invalid_time_format")]
    assert sorted(r["act_ix"] for r in P.missing_costs(segments, acts).collect()) == [0, 1]
