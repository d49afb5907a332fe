"""Results merged as they arrive, third-call alerts, missed calls per window."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

BUCKETS = 256  # folders of a results table; each should hold a few hundred MB at most


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df, whose rows may be late by delay. Event time is a TIMESTAMP, whatever the column was."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def missed_per_window(df: DataFrame, ts: str, tool: str, length: str, delay: str | None = None) -> DataFrame:
    """Rows per tool and window of time. delay: how late rows may be (streams)."""
    rows = watermarked(df, ts, delay) if delay else df
    return rows.groupBy(F.window(ts, length).alias("_w"), tool).agg(F.count("*").alias("missed")).select(F.col("_w.start").alias("start"), tool, "missed")


class Results:
    """A table of results by key, into which batches are merged: a row replaces the one with its key.

    Rows lie in `buckets` folders by a hash of their key, and each folder has two sides. A batch rewrites only
    the folders that it touches, each to the side that isn't in use, and then publishes which sides are, with
    its number, on one of two sides as well. So readers see all of a batch or nothing (a reader may lag behind by
    one batch), a batch that is done again changes nothing, and nothing has to be deleted. The number of buckets is fixed when the table begins.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = BUCKETS):
        """order: of several rows with a key in one batch, the one with the largest counts."""
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets

    def _published(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """The number of the last batch, and the side in use of each bucket that has rows."""
        last, sides = -1, {}
        for side in (0, 1):
            try:
                rows = spark.read.schema("batch long, bucket int, side int").parquet(f"{self.path}/published/side={side}").collect()  # a row a bucket
            except AnalysisException:  # nothing there yet
                continue
            if rows and rows[0]["batch"] > last:
                last, sides = rows[0]["batch"], {r["bucket"]: r["side"] for r in rows if r["bucket"] is not None}
        return last, sides

    def _stored(self, spark: SparkSession, sides: dict[int, int], schema: StructType | None) -> DataFrame:
        paths = [f"{self.path}/rows/_bucket={b}/_side={s}" for b, s in sorted(sides.items())]
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*paths)

    def read(self) -> DataFrame:
        """The rows of all batches so far, one a key."""
        _, sides = self._published(self.spark)
        if not sides:
            raise ValueError(f"no batch has been merged into {self.path}")
        return self._stored(self.spark, sides, None)

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # a stream's batches have a session of their own
        last, sides = self._published(spark)
        if number <= last:  # done before, and published
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = batch.groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).agg(F.max_by(F.struct(*batch.columns), self.order).alias("_r")).select("_r.*")
        newest = newest.withColumn("_bucket", bucket).persist()
        try:
            touched = sorted(r["_bucket"] for r in newest.select("_bucket").distinct().collect())  # as many as there are buckets, at most
            old = {b: sides[b] for b in touched if b in sides}
            rows = newest
            if old:
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
                cond = same[0]
                for c in same[1:]:
                    cond = cond & c
                kept = self._stored(spark, old, batch.schema).withColumn("_bucket", bucket)
                rows = kept.alias("o").join(newest.alias("n"), cond, "left_anti").unionByName(newest)
            turned = {b: 1 - sides[b] if b in sides else 0 for b in touched}
            if touched:
                to = F.create_map(*[F.lit(x) for kv in turned.items() for x in kv])[F.col("_bucket")]
                # one task a bucket: its rows are one file of bounded size
                rows.withColumn("_side", to).repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_side").parquet(f"{self.path}/rows")
        finally:
            newest.unpersist()
        now = sides | turned
        told = spark.createDataFrame([(number, b, s) for b, s in now.items()] or [(number, None, None)], "batch long, bucket int, side int")
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/published/side={number % 2}")


def score_arriving(results: DataFrame, score: Callable[[DataFrame], DataFrame], table: Results, checkpoint: str):
    """A stream of result rows, scored batch by batch and merged into the table by its keys.

    A result that is sent again, in the same batch or a later one, counts once, and so does a batch that is
    replayed after a failure.
    """
    return results.writeStream.foreachBatch(lambda batch, number: table.merge(score(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class LoopGuard(StatefulProcessor):
    """Counts a key's rows over batches and gives back the one that makes it the n-th."""

    def __init__(self, keys: list[str], order: list[str], columns: list[str], n: int, ttl: int | None):
        self.keys, self.order, self.columns, self.n, self.ttl = keys, order, columns, n, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        wanted, count, first = max(self.n - before, 0), 0, []
        for part in rows:
            count += len(part)
            if wanted:  # the first rows in order, as many as are still to come; a hot key's others are only counted
                first = heapq.nsmallest(wanted, first + list(part[self.columns].itertuples(index=False, name=None)), key=lambda r: [r[self.columns.index(c)] for c in self.order])
        self.seen.update((min(before + count, self.n),))
        if wanted and count >= wanted:
            yield pd.DataFrame([first[-1]], columns=self.columns)

    def close(self) -> None:
        pass


def third_calls(calls: DataFrame, keys: list[str], order: list[str], n: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the calls that are the n-th with their keys (trial, tool, arguments), each when it arrives.

    The count of a key is kept from batch to batch, whatever the time between calls, until there was none for
    ttl_ms of processing time (for ever if it is None). Of a batch's calls the order tells which is the n-th.
    A key that has been given isn't given again before its state expires, after a restart from the checkpoint neither.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    guard = LoopGuard(keys, order, calls.columns, n, ttl_ms)
    return calls.groupBy(*keys).transformWithStateInPandas(statefulProcessor=guard, outputStructType=calls.schema, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")
