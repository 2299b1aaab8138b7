import duckdb
import pytest

from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in result.fetchall()) == ours
