import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((str(tuple(r[c] for c in columns)) for r in df.collect()))
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in result.fetchall()) == ours


@pytest.mark.parametrize("name", ["significance", "explanations", "asof_panel", "stored_revisions", "history"])
def test_a_query_leaves_its_result_at_most(spark, name):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    left = set(folder.iterdir()) - before
    assert len(left) == (name != "history") and df.columns


def test_ridge_contributions_add_up(spark):
    from pyspark.sql import functions as F

    from tidemark.plans.queries import _ridge

    made = _ridge(spark, DATA).filter("point is not null")
    off = F.abs(F.col("point") - F.col("intercept") - F.aggregate("drivers", F.lit(0.0), lambda a, d: a + d["contribution"]))
    assert made.filter(off > 1e-6).count() == 0
    assert made.count() > 0


def test_entry_and_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
