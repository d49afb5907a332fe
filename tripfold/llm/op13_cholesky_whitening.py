"""Embedding whitening by shifted CholeskyQR.

With A the centred rows, A = Q R is found without ever forming A's covariance for its eigenvectors: a pass
sums the Gram matrix G of the current rows over all tasks, G plus a small shift is factored by Cholesky, and
from the next pass on rows also go through a triangular solve with that factor, until G is the identity. The
composed R (a matrix of dimensions by dimensions) has A's singular values and right singular vectors, and
its SVD gives the components: small ones too are as exact as A's own numbers, while eigenvectors of A'A
would lose half of the digits. The shift keeps Cholesky from failing while rows are ill-conditioned; along a
direction without variance G stays at 0 instead of 1, and R shrinks to nothing there.

Entries are integers (see SCALE), so sums are exact at any size, and an entry less the whole part of its
mean is exact too. Each pass is one scan of the vectors; a task gives back a partial Gram matrix, and these
are added up in two steps, a row of the matrix at a time. The driver only holds matrices of dimensions by
dimensions. Passes read the given DataFrame again, so it should be a table.

Cases: rows whose vector is null, or has a null or non-finite entry, go; so do rows whose length isn't the
most frequent one (of several, the largest). Entries beyond 2**52 count as 2**52. Components without variance
are left out, so fewer than asked for may come (none, if all rows are equal, or for empty vectors or tables).
A deviation that doesn't fit into a long is null. A null vec_id is a key like any other; repeated rows count
again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import stored

SCALE, OFFSET = 1024, 100_000  # an entry c counts as floor(SCALE * c) + OFFSET
MOST = float(1 << 52)
PASSES = 8  # Gram passes, at most; three do for rows that aren't degenerate
FLAT_PASSES = 4  # after which directions at 0 are taken to have no variance
CLOSE = 1e-12  # distance of G from the identity at which rows are orthonormal
FLAT = 1e-14  # a singular value below FLAT times the largest is no variance
SALT = 64  # first-step parts of a row's sum
COMPONENTS = 8
_EPS = float(np.finfo(np.float64).eps)


def entries(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows to keep, of length d if it is given, and their integer entries, one row after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    flat = column.flatten()  # without the entries of null rows
    c = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # null entries are NaN
    width = np.maximum(size, 0)
    bad = np.bincount(np.repeat(np.arange(len(size)), width)[~np.isfinite(c)], minlength=len(size)) > 0
    keep = (size >= 0) & ~bad if d is None else (size == d) & ~bad
    c = c[np.repeat(keep, width)]
    return np.flatnonzero(keep), np.floor(np.clip(c * SCALE, -MOST, MOST)).astype(np.int64) + OFFSET


def sums(vectors: DataFrame, name: str) -> tuple[int, list[int]]:
    """How many vectors there are of the most frequent length, and the exact sum of each dimension."""

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            keep, x = entries(b.column(0))
            size = pc.list_value_length(b.column(0)).take(pa.array(keep, pa.int64())).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(size, size)
            for d, n in zip(*(v.tolist() for v in np.unique(size, return_counts=True))):
                rows = x[of == d].reshape(n, d)
                high, low = (rows >> 26).sum(0).astype(object), (rows & ((1 << 26) - 1)).sum(0).astype(object)
                held = total.setdefault(d, [0, np.zeros(d, object)])
                held[0] += n
                held[1] = held[1] + high * (1 << 26) + low
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * (d + 1), "k": list(range(-1, d)), "s": list(map(str, [n, *s]))}, pa.schema([("d", pa.int64()), ("k", pa.int64()), ("s", pa.string())]))

    parts = vectors.select(name).mapInArrow(run, "d long, k long, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    held = stored(parts.groupBy("d", "k").agg(F.sum("s").alias("s")))
    top = held.where("k = -1").orderBy(F.desc("s"), F.desc("d")).first()
    if top is None:
        return 0, []
    return int(top["s"]), [int(r["s"]) for r in held.where((F.col("d") == top["d"]) & (F.col("k") >= 0)).orderBy("k").collect()]  # a number for each dimension


class Centred:
    """x less its mean, from exact sums: the whole part of the mean is taken off in integers."""

    def __init__(self, n: int, s: list[int]):
        self.d, self.n = len(s), n
        self.whole = np.array([v // n for v in s], np.int64)
        self.rest = np.array([v % n / n for v in s])
        self.left = [v % n for v in s]

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keep, x = entries(column, self.d)
        return keep, x.reshape(len(keep), self.d) - self.whole

    def deviations(self, x: np.ndarray) -> list:
        """Exact sums of (n * x - S)**2; None beyond a long. x: as rows gives it."""
        bound = self.n * (int(np.abs(x).max(initial=0)) + 1)
        if bound * bound * max(self.d, 1) < 2**63:
            y = x * self.n - np.array(self.left, np.int64)
            return (y * y).sum(1).tolist()
        y = x.astype(object) * self.n - np.array(self.left, object)
        return [v if v < 2**63 else None for v in (y * y).sum(1)]


def solved(a: np.ndarray, factors: list) -> np.ndarray:
    """Rows through triangular solves: a R1^-1 R2^-1 ... for upper triangular factors."""
    for r in factors:
        q = np.empty_like(a)
        for k in range(a.shape[1]):  # forward substitution, a column at a time
            q[:, k] = (a[:, k] - q[:, :k] @ r[:k, k]) / r[k, k]
        a = q
    return a


def added(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of matrices, given as rows (i, part, row): over parts of them first, then over the parts."""

    def run(batches):
        total: dict = {}
        for b in batches:
            rows = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            for key, row in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), rows):
                total[key] = total[key] + row if key in total else row.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in total], "part": [0] * len(total), "row": [r.tolist() for r in total.values()]}, SUM)

    first = parts.withColumn("part", F.pmod("part", F.lit(SALT)).cast("int")).repartition("i", "part").mapInArrow(run, KIND)
    out = np.zeros((d, d))
    for r in first.repartition("i").mapInArrow(run, KIND).collect():  # a row for each dimension
        out[r["i"]] = r["row"]
    return out


KIND = "i int, part int, row array<double>"
SUM = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("row", pa.list_(pa.float64()))])


def gram(vectors: DataFrame, name: str, centre: Centred, turned, width: int) -> np.ndarray:
    """The Gram matrix of turned(centred rows), which have `width` columns, over all vectors."""

    def run(batches):
        total = None
        for b in batches:
            keep, x = centre.rows(b.column(0))
            if len(keep):
                q = turned(x - centre.rest)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            k = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "part": [k] * len(total), "row": total.tolist()}, SUM)

    return added(vectors.select(name).mapInArrow(run, KIND), width)


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular factor of g plus a shift (a share of its trace), larger where that isn't enough."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * float(np.trace(g)) * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, 11 * _EPS * len(g) * (len(g) + 1))


def factored(vectors: DataFrame, name: str, centre: Centred) -> np.ndarray:
    """R of the centred rows (dimensions by dimensions), from Gram passes."""
    d, factors, r = centre.d, [], np.eye(centre.d)
    for k in range(PASSES):
        g = gram(vectors, name, centre, lambda a, f=tuple(factors): solved(a, f), d)
        if not np.trace(g) > 0:
            return np.zeros((d, d))
        if k:
            own, turn = np.linalg.eigh(g)
            flat, round_ = np.abs(own) < CLOSE * d, np.abs(own - 1) < CLOSE * d
            if round_.all() or (flat | round_).all() and k >= FLAT_PASSES or k == PASSES - 1:
                return np.sqrt(np.where(flat, 0.0, np.maximum(own, 0)))[:, None] * (turn.T @ r)
        step = factor(g, 0.0 if k else 11 * _EPS * d * (d + 1))
        factors.append(step)
        r = step @ r
    return r


def components(vectors: DataFrame, name: str, centre: Centred, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as columns) and eigenvalues of the covariance, the largest first, and its trace."""
    r = factored(vectors, name, centre)
    _, s, v = np.linalg.svd(r)
    k = int((s > FLAT * s[0]).sum()) if len(s) and s[0] > 0 else 0
    k = min(k, most)
    return v[:k].T.copy(), s[:k] ** 2 / centre.n, float((s**2).sum() / centre.n)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """See OUT: a row for each remaining vector and each of its first `most` components."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    n, s = sums(given, "_v")
    if not n or not s:
        return spark.createDataFrame([], OUT)
    centre = Centred(n, s)
    v, e, trace = components(given, "_v", centre, most)
    if not len(e):
        return spark.createDataFrame([], OUT)
    turn = v / np.sqrt(e)

    def whitened(a: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk->ik", a, turn)  # equal rows get equal values, whatever batch they are in

    ones = lambda a: np.c_[whitened(a), np.ones(len(a))]  # noqa: E731  the last row of the Gram matrix holds sums
    g = gram(given, "_v", centre, ones, len(e) + 1)
    mean = g[-1, :-1] / n
    error = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(e))).max())
    share = e / trace

    def run(batches):
        for b in batches:
            keep, x = centre.rows(b.column(1))
            k, m = len(e), len(keep)
            z = whitened(x - centre.rest)
            ids = b.column(0).take(pa.array(np.repeat(keep, k)))
            far = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far, pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return given.mapInArrow(run, OUT)


def op13_cholesky_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
