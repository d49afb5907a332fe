"""Streams give the rows of their batch forms, also over restarts and repeated batches."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tripfold.operators import toolcalls as T
from tripfold.streaming import jobs

CALL = "trial long, tool string, arguments string, day int, seq long"
KEYS = ["trial", "tool", "arguments"]


def _stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    cut = events.select("*", (F.col("event_id") % 2).alias("half"))
    folder = f"{tmp_path}/in"
    cut.where("half = 0").drop("half").coalesce(1).write.parquet(folder)
    return events, spark.readStream.schema(events.schema).parquet(folder), lambda: cut.where("half = 1").drop("half").coalesce(1).write.mode("append").parquet(folder)


def _run(df, tmp_path, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_windows(spark, tmp_path):
    events, stream, more = _stream(spark, tmp_path)
    more()
    _run(jobs.missed_per_window(stream, "ts", "event_type", "1 hour", "60 days"), tmp_path, "missed", "complete")
    batch = jobs.missed_per_window(events, "ts", "event_type", "1 hour")
    shown = lambda df: sorted(map(tuple, df.withColumn("start", F.col("start").cast("string")).collect()))
    assert shown(spark.table("missed")) == shown(batch)


def test_late_rows_are_dropped(spark, tmp_path):
    folder, kind = f"{tmp_path}/late", "ts timestamp, tool string"
    put = lambda *rows: spark.createDataFrame([(r, "a") for r in rows], "ts string, tool string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "tool").coalesce(1).write.mode("append").parquet(folder)

    def step():
        df = jobs.missed_per_window(spark.readStream.schema(kind).parquet(folder), "ts", "tool", "1 hour", "10 minutes").withColumn("start", F.col("start").cast("string"))
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/late-out").option("checkpointLocation", f"{tmp_path}/late-ck").trigger(availableNow=True).start()
        q.awaitTermination(120)

    for rows in (("2025-01-01 10:00:00", "2025-01-01 10:30:00"), ("2025-01-01 12:00:00",), ("2025-01-01 10:40:00", "2025-01-01 11:55:00"), ("2025-01-01 15:00:00",), ("2025-01-01 15:01:00",)):
        put(*rows)
        step()
    got = {r["start"]: r["missed"] for r in spark.read.parquet(f"{tmp_path}/late-out").collect()}
    assert got == {"2025-01-01 10:00:00": 2, "2025-01-01 11:00:00": 1, "2025-01-01 12:00:00": 1}  # 10:40 came too late


class Calls:
    """A folder of calls that is read as a stream, a run for each batch of rows, with one checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options, self.n = spark, str(tmp_path), options, 0

    def run(self, rows):
        self.spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(f"{self.path}/calls")
        df = jobs.third_calls(self.spark.readStream.schema(CALL).parquet(f"{self.path}/calls"), KEYS, ["day", "seq"], **self.options)
        found = []
        q = df.writeStream.outputMode("append").foreachBatch(lambda b, _: found.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{self.path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return found


def test_third_call_is_alerted_once_over_days_and_restarts(spark, tmp_path):
    calls = Calls(spark, tmp_path)
    a = lambda day, seq: (1, "t", "x", day, seq)
    assert calls.run([a(1, 1), a(1, 2), (1, "t", "y", 1, 3), (2, "t", "x", 1, 4)]) == []
    assert calls.run([a(2, 6), a(2, 5), (2, "t", "x", 2, 9)]) == [a(2, 5)]  # the first of the batch, not the first read
    assert calls.run([a(3, 7), a(3, 8), (2, "t", "x", 3, 10), (2, "t", "x", 3, 11)]) == [(2, "t", "x", 3, 10)]
    assert calls.run([a(4, 12), (1, "t", None, 4, 13), (1, "t", None, 4, 15), (1, "t", None, 4, 14), (1, "t", None, 4, 16)]) == [(1, "t", None, 4, 15)]


def test_state_expires(spark, tmp_path):
    calls = Calls(spark, tmp_path, ttl_ms=1_500)
    row = lambda seq: (1, "t", "x", 1, seq)
    assert calls.run([row(1), row(2)]) == []
    time.sleep(3)
    assert calls.run([row(3)]) == []  # the two before are forgotten
    time.sleep(3)
    assert calls.run([row(4), row(5), row(6)]) == [row(6)]


def test_third_calls_of_a_stream_are_those_of_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id AS trial", "event_type AS tool", "cast(null as string) AS arguments", "1 AS day", "event_id AS seq")
    rows = sorted(map(tuple, events.collect()), key=lambda r: r[4])
    calls = Calls(spark, tmp_path)
    got = [r for k in range(0, len(rows), 400) for r in calls.run(rows[k : k + 400])]
    want = T.third_calls(events, ["trial", "tool"], ["seq"], F.expr("seq div 100"))
    assert sorted(r[4] for r in got) == sorted(r["seq"] for r in want.collect()) and len(got) > 50


RESULT = "task long, trial long, at long, score double"


def test_results_that_arrive_again_count_once(spark, tmp_path):
    table = jobs.Results(spark, f"{tmp_path}/out", ["task", "trial"], "at", buckets=4)
    score = lambda df: df.withColumn("score", F.col("score") * 2)
    want: dict = {}
    batches = [
        [(1, 0, 1, 1.0), (2, 0, 2, 2.0), (2, 0, 3, 2.5), (None, 1, 4, 7.0)], [(1, 0, 5, 1.5), (3, 1, 6, 3.0)], [(None, 1, 7, 8.0)], [(k, 0, 10 + k, float(k)) for k in range(40)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.score_arriving(spark.readStream.schema(RESULT).parquet(f"{tmp_path}/in"), score, table, f"{tmp_path}/ck").start().awaitTermination(120)
        for r in sorted(rows, key=lambda r: r[2]):
            want[r[:2]] = (*r[:3], r[3] * 2)
        assert Counter(map(tuple, table.read().collect())) == Counter(want.values())


def test_replayed_and_broken_batches_count_once(spark, tmp_path, monkeypatch):
    table = jobs.Results(spark, f"{tmp_path}/out", ["task", "trial"], "at", buckets=3)
    df = lambda *rows: spark.createDataFrame(rows, RESULT)
    rows = lambda: sorted(map(tuple, table.read().collect()))
    with pytest.raises(ValueError):
        table.read()
    table.merge(df((1, 0, 1, 1.0), (2, 0, 1, 2.0)), 0)
    table.merge(df((1, 0, 1, 9.0)), 0)  # the same batch again
    assert rows() == [(1, 0, 1, 1.0), (2, 0, 1, 2.0)]
    table.merge(df((1, 0, 2, 3.0)), 1)
    # a batch that ends after its rows were written, but before they were published
    publish = table._published
    monkeypatch.setattr(table, "_published", lambda spark: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(df((2, 0, 3, 5.0)), 2)
    monkeypatch.setattr(table, "_published", publish)
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    batch = spark.sql("SELECT 2L AS task, 0L AS trial, 3L AS at, 5.0D AS score")
    with pytest.raises(RuntimeError):
        table.merge(batch, 2)
    assert rows() == [(1, 0, 2, 3.0), (2, 0, 1, 2.0)]
    monkeypatch.undo()
    table.merge(batch, 2)
    assert rows() == [(1, 0, 2, 3.0), (2, 0, 3, 5.0)]
    table.merge(df().limit(0), 3)
    assert rows() == [(1, 0, 2, 3.0), (2, 0, 3, 5.0)]
