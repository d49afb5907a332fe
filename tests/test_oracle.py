"""Every query with an SQL twin gives the twin's rows on the small tables."""

import math

import duckdb
import pytest

from tests.conftest import SF
from tripfold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in df.collect())
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted([shown(r[names.index(c)]) for c in columns] for r in cur.fetchall())
    assert got == want


def test_no_pairwise_plans(spark):
    for name in ("q_substr", "q_suffix", "q_known", "q_anti", "q_repeat"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
