"""Every query of the catalogue against its SQL, and a few laws."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from roundhouse.plans import chances
from roundhouse.plans.registry import QUERIES, SQL
from roundhouse.sources.sessions import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    rows = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    """Queries without SQL give rows of the columns they name; their operators are tested by themselves."""
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and rows[0].asDict().keys() == set(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_swing_sums_to_nothing(spark, small):
    sums = chances.swing_rows(session(spark, small)).groupBy("round_num").agg(F.sum("credit").alias("s")).collect()
    assert sums and all(abs(r["s"]) < 1e-9 for r in sums)


def test_chances(spark):
    """Even chances are symmetric; a level score goes to overtime, where three more rounds win; certainty only where a match is won."""
    v = {(r["a"], r["b"]): r["chance"] for r in chances.chance_table(spark).collect()}
    assert v[0, 0] == 0.5 and all(abs(x + v[b, a] - 1) < 1e-12 for (a, b), x in v.items())
    assert v[13, 11] == 1.0 and 0.5 < v[13, 12] < 1.0 and v[12, 12] == 0.5 and v[16, 14] == 1.0 and v[15, 15] == 0.5 and 0.5 < v[16, 15] < 1.0
    assert all(v[a + 1, b] >= x - 1e-12 for (a, b), x in v.items() if (a + 1, b) in v)
    strong = {(r["a"], r["b"]): r["chance"] for r in chances.chance_table(spark, p=0.6).collect()}
    assert strong[0, 0] > 0.5 and strong[12, 12] > 0.5


def test_rounds_do_not_grow(spark, small, middle):
    """More data is more matches: what a round holds stays as it is."""
    per = [session(spark, d).ev.groupBy("round_num").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0] for d in (small, middle)]
    assert per[1] < 1.6 * per[0]
