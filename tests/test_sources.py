"""Stores and logs: what is written is read, and only what is asked for."""

from tests.conftest import SF
from tripfold.operators import toolcalls as T
from tripfold.sources import tables


def test_example_store(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("concat('t', label % 3) AS tool", "vec_id AS example", "embedding AS evec")
    tables.write_examples(e, f"{tmp_path}/store")
    tables.write_examples(e, f"{tmp_path}/store")  # replaces, doesn't add
    every = tables.read_examples(spark, f"{tmp_path}/store")
    key = lambda df: sorted((r["tool"], r["example"], tuple(r["evec"])) for r in df.collect())
    assert key(every) == key(e)
    some = tables.read_examples(spark, f"{tmp_path}/store", ["t1", "t2"])
    assert key(some) == key(e.where("tool in ('t1', 't2')"))
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [tool" in plan.replace("isnotnull(tool#", "tool#").replace("[isnotnull(", "[") or "PartitionFilters: [" in plan


def test_missed_calls(spark, tmp_path):
    log = spark.createDataFrame([("a", "{}", "r", 1.0), ("b", "{}", "r", 2.0)], "tool string, params string, simulated_result string, timestamp double")
    tables.append_missed(log, f"{tmp_path}/log")
    tables.append_missed(log, f"{tmp_path}/log")
    assert tables.read_missed(spark, f"{tmp_path}/log").count() == 4 and tables.read_missed(spark, f"{tmp_path}/log", "a").count() == 2
    tables.clear_missed(spark, f"{tmp_path}/log", "a")
    assert [r["tool"] for r in tables.read_missed(spark, f"{tmp_path}/log").collect()] == ["b", "b"]


def test_new_rules_are_rows(spark):
    calls = spark.createDataFrame([(1, "new", '{"n":3}'), (2, "new", '{"n":9}'), (3, "new", "{}"), (4, "maps_geo", '{"address":"x"}'), (5, "new", '{"n":1,"m":2}')], "id long, tool string, arguments string")
    rules = spark.createDataFrame([("new", 0, "known", None, ["n"], None, None, "odd"), ("new", 1, "required", None, ["n"], None, None, "needs_n"), ("new", 2, "range", "n", None, 0.0, 5.0, "too_many")], T.RULE)
    cities = spark.createDataFrame([("x",)], "name string")
    got = {r["id"]: r["code"] for r in T.validate_calls(calls, "id", cities, rules).collect()}
    assert got == {1: None, 2: "too_many", 3: "needs_n", 4: "unknown_tool", 5: "odd"}
    assert {r["id"]: r["code"] for r in T.validate_calls(calls, "id", cities).collect()}[4] is None
