import duckdb
import pytest

import __spark_entry__ as entry
from kindred.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([(n, _plain(v)) for n, v in sorted(zip(names, r))]) for r in cur.fetchall())
    df = entry.queries()[name](spark, DATA)
    got = sorted(repr([(n, _plain(r[n])) for n in sorted(df.columns)]) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["id1", "id2", "p"]
