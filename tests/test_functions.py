"""Golden cases of the column helpers; expected values follow from the rules."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tripfold.functions import fixed, jsonx, ratings, text, times


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_imports_without_a_session():
    code = "import __spark_entry__, corpus_pipeline" if __import__("os").path.exists(f"{ROOT}/corpus_pipeline.py") else "import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.parametrize("t,want", [("9:5", 545), ("24:00", None), ("12:30x", None), ("12:30\n", None), ("00:00", 0), (None, None)])
def test_minutes(spark, t, want):
    assert one(spark, t, times.minutes("x")) == want


@pytest.mark.parametrize("c,bad", [("120.5, 30", False), ("190,3", True), ("1,2,3", True), ("12d,3", True), ("a,b", True)])
def test_coordinates(spark, c, bad):
    assert one(spark, c, times.coordinate_error(F.col("x"))) is bad


@pytest.mark.parametrize("name,key", [("西安市", "西安"), ("市", "市"), ("恩施自治州", "恩施"), ("大兴安岭地区", "大兴安岭地"), ("西安市\n", "西安市\n")])
def test_city_key(spark, name, key):
    assert one(spark, name, text.city_key("x")) == key


@pytest.mark.parametrize(
    "said,path,value,status",
    [
        ("好 [global_constraints.avg_budget : 1800]", "global_constraints.avg_budget", "1800", "ok"),
        ('[a.b : ["x"]]', "a.b", '["x"]', "ok"),
        ("[a.b : []", "a.b", "[]", "repaired"),
        ('[a.b : ["x"]', "a.b", '["x"]', "repaired"),
        ("[a.b : 高铁]", "a.b", '"高铁"', "bare"),
        ("[a.b : 1] 再见", None, None, None),
        (None, None, None, None),
    ],
)
def test_marker(spark, said, path, value, status):
    m = one(spark, said, text.marker("x"))
    assert (m["path"], m["value"], m["status"]) == (path, value, status)


@pytest.mark.parametrize("bad,good", [("global_constraints_constraints.avg_budget", "global_constraints.avg_budget"), ("a.a.b", "a.b"), ("a.b", "a.b")])
def test_path(spark, bad, good):
    assert one(spark, bad, text.fix_path("x")) == good


def test_mention(spark):
    assert one(spark, "@User1 and @User2请", text.mention("x", ["User1", "User2"])) == "User2"
    assert one(spark, "@User12", text.mention("x", ["User1"])) is None


@pytest.mark.parametrize("said,left", [("ok [pass] [PASS]\n", "ok"), (" [pass] ", " [pass] "), ("ok", "ok")])
def test_pass(spark, said, left):
    assert one(spark, said, text.strip_pass("x")) == left


def test_embedded_json(spark):
    said = 'x {"days":[{"c":"}"}]} tail'
    assert one(spark, said, text.embedded_json("x", "days")) == '{"days":[{"c":"}"}]}'
    assert one(spark, 'a ```json\n{"days": 1}\n``` {"days": 2}', text.embedded_json("x", "days")) == '{"days":1}'
    assert one(spark, "no plan", text.embedded_json("x", "days")) is None
    assert one(spark, None, text.embedded_json("x", "days")) is None


def test_cache_key(spark):
    want = '[["a","x"],["b",1]]'
    assert one(spark, '{"b":1,"a":"x"}', jsonx.cache_key("x")) == want == one(spark, '{"a":"x","b":1}', jsonx.cache_key("x"))
    assert one(spark, '{"a":1,"a":2}', jsonx.cache_key("x")) == '[["a",2]]'
    assert one(spark, "[1,2]", jsonx.cache_key("x")) == "[1,2]"
    assert one(spark, "not json", jsonx.cache_key("x")) == "not json"


def test_params_of(spark):
    assert one(spark, '[["a",1],["a",2],["b"],[null,3]]', jsonx.params_of("x")) == '{"a":2}'
    assert one(spark, "[]", jsonx.params_of("x")) is None


@pytest.mark.parametrize("j,kind", [("1", "integer"), ("1.5", "number"), ("123456789012345678901234", "integer"), ("true", "boolean"), ('"a"', "string"), ("null", "null"), ("[]", "array"), ("{}", "object"), ("{} x", None)])
def test_json_kind(spark, j, kind):
    assert one(spark, j, jsonx.json_kind("x")) == kind


@pytest.mark.parametrize("low,high,want", [(4.0, 8.0, 50.0), (-1.0, 5.0, 0.0), (-4.0, -2.0, 50.0), (-3.0, 0.0, 0.0), (0.0, 0.0, 100.0), (None, None, 100.0)])
def test_fairness(spark, low, high, want):
    row = spark.createDataFrame([(low, high)], "a double, b double").select(ratings.fairness("a", "b").alias("y")).first()
    assert row["y"] == want and str(row["y"]) == str(want)


def test_rating(spark):
    assert [one(spark, s, ratings.rating_score("x")) for s in ("评级：优秀", "较好。", "?", list(fixed.RATINGS)[0])] == [5, 4, None, 1]


@pytest.mark.parametrize("said,cls", [("429 Too many", "rate_limit"), ("x Timeout", "connection_error"), ("maximum context length", "context_overflow"), ("?", "runtime_error")])
def test_error_class(spark, said, cls):
    assert one(spark, said, text.classify_error("x")) == cls
