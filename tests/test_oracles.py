"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        found = duck.execute(SQL[name])
        order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
        assert [found.description[i][0] for i in order] == cols
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_entry():
    """Importing the entry needs no session; SQL belongs to registered queries."""
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", ["hkg_nodes", "hkg_summary", "nms", "reading_order", "extraction_batches_atomic"])
def test_one_shuffle(spark, name):
    """Scans over a document's rows deal them out once."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
