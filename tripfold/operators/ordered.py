"""Running values over ordered groups, without one task per hot group.

A plain window puts a whole group into one task. ``running`` cuts each group
into chunks along its order, summarises the chunks (map-side combined), runs a
window over the summaries only, and finishes inside each chunk. The largest sort
is one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Running:
    """One running value.

    kind: ``max`` · ``sum`` · ``last`` (last non-null) before the row,
    ``sum_upto`` including it, ``prev`` / ``next`` = the neighbour's value.
    """

    name: str
    kind: str
    value: Column


def chunk_of(position: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a non-negative integer position that is dense within its group: ≤ ``rows`` rows each."""
    return F.expr(f"`{position}` div {rows}")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def running(df: DataFrame, keys: list[str], order: list[str], values: list[Running],
            chunk: Column | None = None) -> DataFrame:
    """Add every running value to ``df``.

    ``chunk`` must grow with ``order`` and have few distinct values per group, such
    as the hour. Leave it out only for groups bounded by one input row, such as the
    activities of one parsed plan. The input is evaluated twice, so it must be
    deterministic; sums of floats depend on the order of addition, sum decimals.
    """
    for v in values:
        df = df.withColumn(f"_v_{v.name}", v.value)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        for v in values:
            local = _local(v, w)
            df = df.withColumn(v.name, local["v"] if v.kind in ("prev", "next") else local)
        return df.drop(*[f"_v_{v.name}" for v in values])

    df = df.withColumn("_chunk", chunk)
    at = F.struct(*order)
    totals = df.groupBy(*keys, "_chunk").agg(*[_total(v, at).alias(f"_c_{v.name}") for v in values])
    over = Window.partitionBy(*keys).orderBy("_chunk")
    carry = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"),
                          *[_carry(v, over).alias(f"_c_{v.name}") for v in values])
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys]
                   + [df["_chunk"] == carry["_k_chunk"]])
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = df.join(carry.hint("merge"), match, "left")  # with many small groups there are nearly as many chunks as rows
    for v in values:
        out = out.withColumn(v.name, _join_up(v, _local(v, w), F.col(f"_c_{v.name}")))
    drop = [f"_k_{k}" for k in keys] + ["_k_chunk", "_chunk"]
    drop += [f"_{p}_{v.name}" for v in values for p in "vc"]
    return out.drop(*drop)


def _local(v: Running, w) -> Column:
    x = F.col(f"_v_{v.name}")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if v.kind == "max":
        return F.max(x).over(before)
    if v.kind == "sum":
        return F.coalesce(F.sum(x).over(before), F.lit(0))
    if v.kind == "sum_upto":
        return F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    if v.kind == "last":
        return F.last(x, ignorenulls=True).over(before)
    if v.kind == "prev":
        return F.lag(F.struct(x.alias("v"))).over(w)  # a null struct: no neighbour row here
    if v.kind == "next":
        return F.lead(F.struct(x.alias("v"))).over(w)
    raise ValueError(v.kind)


def _total(v: Running, at: Column) -> Column:
    x = F.col(f"_v_{v.name}")
    if v.kind == "max":
        return F.max(x)
    if v.kind in ("sum", "sum_upto"):
        return F.coalesce(F.sum(x), F.lit(0))
    if v.kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), at))
    if v.kind == "prev":
        return F.max_by(F.struct(x.alias("v")), at)
    return F.min_by(F.struct(x.alias("v")), at)


def _carry(v: Running, over) -> Column:
    c = F.col(f"_c_{v.name}")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    if v.kind == "max":
        return F.max(c).over(before)
    if v.kind in ("sum", "sum_upto"):
        return F.sum(c).over(before)
    if v.kind == "last":
        return F.last(c, ignorenulls=True).over(before)
    if v.kind == "prev":
        return F.lag(c).over(over)
    return F.lead(c).over(over)


def _join_up(v: Running, local: Column, carry: Column) -> Column:
    if v.kind == "max":
        return F.greatest(local, carry)
    if v.kind in ("sum", "sum_upto"):
        return local + F.coalesce(carry, F.lit(0))
    if v.kind == "last":
        return F.coalesce(local, carry)
    return F.when(local.isNotNull(), local["v"]).otherwise(carry["v"])
