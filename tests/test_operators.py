"""Running values against a plain window, itinerary rules and the writers."""

import pytest
from pyspark.sql import functions as F

from tripfold.operators import itinerary as I
from tripfold.operators import scoring as S
from tripfold.operators.lookups import within_opening
from tripfold.operators.ordered import Running, chunk_of, running
from tripfold.sources import tables


@pytest.mark.parametrize("kind", ["max", "sum", "sum_upto", "last", "prev", "next"])
def test_running_in_chunks(spark, kind):
    rows = [(k, i, None if (i * 7 + k) % 4 == 0 else (i * 13) % 11) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    values = [Running("y", kind, F.col("v"))]
    plain = sorted(map(tuple, running(df, ["k"], ["i"], values).collect()), key=str)
    assert sorted(map(tuple, running(df, ["k"], ["i"], values, chunk_of("i", 6)).select("k", "i", "v", "y").collect()), key=str) == plain


ACTS = "usr int, d int, ix int, hr int, typ string, st int, en int, loc string, cost double"


def acts(spark, rows):
    return spark.createDataFrame([(1, 1, i, st // 60, typ, st, en, loc, 1.0) for i, (typ, st, en, loc) in enumerate(rows)], ACTS)


def test_overlaps_touching_and_overnight(spark):
    a = acts(spark, [("food", 600, 660, "a"), ("rest", 660, 700, "b"), ("food", 650, 670, "c"), ("hotel", 600, 900, "d"), ("food", 640, 100, "e")])
    assert sorted(map(tuple, I.overlap_pairs(a, ["usr", "d"]).select("ix_a", "ix_b").collect())) == [(0, 2), (1, 2)]
    assert {r["ix"]: r["conflict"] for r in I.with_conflict(a, ["usr", "d"]).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}
    assert I.islands(a, ["usr", "d"]).select("island").distinct().count() == 1


def test_the_list_decides_what_comes_before(spark):
    a = acts(spark, [("food", 840, 900, "a"), ("food", 540, 600, "b"), ("hotel", 500, 480, "c"), ("rest", 1200, 60, "d"), ("food", 580, 620, "e")])
    order, chunk = ["ix"], chunk_of("ix", 2)
    # 14:00 then 9:00 is an issue; neither the hotel nor the end past midnight moves the clock
    assert sorted(r["ix"] for r in I.backwards(a, ["usr", "d"], order, chunk).collect()) == [1, 2, 4]
    ends = I.day_ends(a, ["usr", "d"], "loc", order).first()
    assert (ends["first_place"], ends["last_place"]) == ("a", "e")
    assert sorted((r["ix"], r["before"]) for r in I.place_changes(a, ["usr", "d"], "loc", order, chunk).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    two = a.unionByName(a.withColumn("d", F.lit(2)))
    assert [(r["d"], r["issue"]) for r in I.nights_without_hotel(two, "usr", "d", order).collect()] == [(1, "hotel_not_last")]


def test_pairs_count_once_over_many_hours(spark):
    a = acts(spark, [("food", 0, 600, "a"), ("rest", 10, 590, "b")])
    assert I.overlap_pairs(a, ["usr", "d"]).count() == 1


def test_empty_groups(spark):
    a = acts(spark, []).limit(0)
    for df in (I.overlap_pairs(a, ["usr"]), I.with_conflict(a, ["usr"]), I.islands(a, ["usr"]), I.misplaced(a, ["usr"], ["ix"], chunk_of("ix")), I.backwards(a, ["usr"], ["ix"], chunk_of("ix"))):
        assert df.count() == 0


def test_completeness(spark):
    p = spark.createDataFrame([(1, ["b", "c"], ["a", "b", "b"])], "u int, a array<string>, r array<string>")
    m = S.compare_lists(p, "a", "r").select("u", "collected", "possible", "correct", "agent_total")
    s = S.compare_scalars(spark.createDataFrame([(1, None, 100)], "u int, a int, r int"), "a", "r").select("u", "collected", "possible", "correct", "agent_total")
    r = S.prf(m.unionByName(s), "u").first()
    assert (r["recall"], r["precision"], round(r["f1"], 9)) == (0.5, 1 / 3, 0.4)


def test_opening(spark):
    v = [(1, "p", "2025-12-15", "9:00", "10:00"), (2, "p", "2025-06-01", "09:00", "10:00"), (3, "p", "2025-12-13", "09:00", "10:00"), (4, "q", "2025-12-15", "09:00", "10:00"), (5, "p", "2025-12-15", "8:00", "9:30")]
    visits = spark.createDataFrame(v, "visit int, place string, d string, s string, e string").withColumn("d", F.to_date("d"))
    rules = spark.createDataFrame([("p", 0, "11-01", "03-31", [1, 2, 3, 4, 5], [("08:30", "17:00")]), ("p", 1, "11-01", "03-31", [6, 7], [("00:00", "24:00")])],
                                  "place string, rule_ix int, season_start string, season_end string, weekdays array<int>, windows array<struct<open: string, close: string>>")
    # texts: "10:00" <= "17:00" and "9:00" >= "08:30"; a wrong weekday closes though a later rule would match
    assert {r["visit"]: r["open"] for r in within_opening(visits, rules).collect()} == {1: True, 2: None, 3: False, 4: None, 5: False}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.jsonl").write_text('{"a":1}\n\n[1]\n{"a":\n')
    good, bad = tables.read_lines(spark, f"{tmp_path}/in/r.jsonl")
    assert good.count() == 1 and sorted(r["line"] for r in bad.collect()) == ["[1]", '{"a":']
    (tmp_path / "in" / "a.tsv").write_text("name\tcode\tcity\nX\t110000\t10\nY\t11\t10\nZ\t110000\n")
    good, bad = tables.read_admin(spark, f"{tmp_path}/in/a.tsv")
    assert [r["name"] for r in good.collect()] == ["X"] and bad.count() == 2
    df = spark.createDataFrame([("x", "p", 1.0), ("y", "q", 2.0)], "tool string, params string, timestamp double")
    tables.append_missed(df, f"{tmp_path}/m")
    tables.append_missed(df, f"{tmp_path}/m")
    tables.clear_missed(spark, f"{tmp_path}/m", "x")
    assert {r["tool"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/m").groupBy("tool").count().collect()} == {"y": 2}
    tables.append_results(df, f"{tmp_path}/j", False)
    tables.append_results(df, f"{tmp_path}/j", True)
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    tables.write_scores({"a": df}, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/a").count() == 2
