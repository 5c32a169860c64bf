import duckdb
import pytest

import __spark_entry__ as e
from sitefacts import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_rows(spark, name):
    df = e.queries()[name](spark, SF)
    if name not in e.oracle_sql():
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    ours = df.select(*cols).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in ours) == sorted(repr(tuple(map(plain, r))) for r in theirs) and ours
