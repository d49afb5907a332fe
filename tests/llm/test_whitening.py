import numpy as np
import pytest

from tripfold.llm import op13_cholesky_whitening as W

KIND = "vec_id long, embedding array<float>, label int, component int, n long, _v string"


def rows_of(vectors, ids=None):
    return [(i if ids is None else ids[i], v, 1, 2, 3, "x") for i, v in enumerate(vectors)]


def exact(vectors):
    """x, and covariance, eigenvalues and vectors from exact centred rows."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    a = ((x * n - s) / n).astype(float)
    e, v = np.linalg.eigh(a.T @ a / n)
    return x, n, s, a, e[::-1], v[:, ::-1]


def scaled(n, d, seed=0, low=0.0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, (n, d)) * np.logspace(0, low, d)
    return (a @ np.linalg.qr(rng.normal(0, 1, (d, d)))[0] + 3 * rng.normal(0, 1, d)).astype(np.float32).tolist()


@pytest.mark.parametrize("n,d,low", [(500, 16, -1.0), (300, 12, -3.0), (12, 10, 0.0), (200, 3, 0.0)])
def test_against_eigenvectors(spark, n, d, low):
    given = scaled(n, d, n, low)
    x, n, s, a, e, v = exact(given)
    df = spark.createDataFrame(rows_of(given), KIND).repartition(5)
    got = W.whitening(df).toPandas()
    k = min(d, 8)
    assert len(got) == n * k and (got.n == n).all() and sorted(got.component.unique()) == list(range(1, k + 1))
    far = [int(((r * n - s) ** 2).sum()) for r in x]
    assert (got.deviation == got.vec_id.map(dict(enumerate(far)))).all()
    for c in range(k):
        mine = got[got.component == c + 1].sort_values("vec_id")
        want = a @ v[:, c] / np.sqrt(e[c])
        sign = np.sign(want @ mine.whitened.values)
        assert np.allclose(mine.whitened.values * sign, want, atol=1e-7 if low > -3 else 1e-5)
        assert np.allclose(mine.explained, e[c] / e.sum(), rtol=1e-6 if low > -3 else 1e-4)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_components_far_below_the_largest(spark):
    """Variances that differ by 1e14: the small ones are lost to double precision in the covariance's eigenvectors."""
    rng = np.random.default_rng(4)
    big = rng.normal(0, 1, (400, 1)) * 2.0**21
    mix = np.repeat(np.round(big), 4, 1) + rng.integers(-3, 4, (400, 4))  # floats that are exact
    got = W.whitening(spark.createDataFrame(rows_of(mix.astype(np.float32).tolist()), KIND), most=4).toPandas()
    assert got.component.nunique() == 4 and got.identity_error.iloc[0] < 1e-4
    x, n, s, *_ = exact(mix)
    diff = (x[:, 1:] - x[:, :1]).astype(float)  # what the common part hides
    small = np.linalg.eigvalsh(np.cov(diff.T, bias=True)).min()
    last = got[got.component == 4].explained.iloc[0] * np.var([float(v) for v in x[:, 0]]) * 4
    assert 0.05 * small < last < small


def test_rows_that_go_and_flat_directions(spark):
    good = [[float(a), float(b), 5.0, float(a + b)] for a in range(6) for b in range(5)]  # rank two
    nan, inf = float("nan"), float("inf")
    odd = [None, [1.0, None, 2.0, 3.0], [nan, 1.0, 1.0, 1.0], [1.0, 1.0, inf, 1.0], [1.0, -inf, 1.0, 1.0], [], [1.0, 2.0]]
    df = spark.createDataFrame(rows_of(good + odd + [good[3]], [*range(30), *range(100, 107), None]), KIND)
    got = W.whitening(df).toPandas()
    assert set(got.vec_id.dropna()) == set(range(30)) and got.vec_id.isna().sum() == 2
    assert sorted(got.component.unique()) == [1, 2] and got.identity_error.iloc[0] < 1e-9 and (got.n == 31).all()
    assert abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-9
    twins = got[(got.vec_id == 3) | got.vec_id.isna()]
    assert all(len(set(g.whitened)) == 1 for _, g in twins.groupby("component"))


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [[], [], [1.0]]])
def test_nothing_to_whiten(spark, vectors):
    assert W.whitening(spark.createDataFrame(rows_of(vectors), KIND)).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    got = W.whitening(spark.createDataFrame(rows_of([[1e9, 0.0], [-1e9, 1.0], [3.0, 2.0]]), KIND)).toPandas()
    assert got.deviation.isna().sum() == 4 and got.identity_error.iloc[0] < 1e-4
    small = got[got.vec_id == 2].deviation.iloc[0]
    x, n, s, *_ = exact([[1e9, 0.0], [-1e9, 1.0], [3.0, 2.0]])
    assert int(small) == int(((x[2] * n - s) ** 2).sum())


def test_sums_are_exact(spark):
    big = [[float(2**40 + i), -float(2**41)] for i in range(50)]
    n, s = W.sums(spark.createDataFrame([(v,) for v in big], "v array<double>").repartition(3), "v")
    assert (n, s) == (50, [sum(1024 * (2**40 + i) + 100_000 for i in range(50)), 50 * (-1024 * 2**41 + 100_000)])


def test_triangular_solves():
    rng = np.random.default_rng(0)
    a, r = rng.normal(0, 1, (7, 5)), [np.triu(rng.normal(0, 1, (5, 5))) + 3 * np.eye(5) for _ in range(2)]
    assert np.allclose(W.solved(a, r) @ r[1] @ r[0], a)
