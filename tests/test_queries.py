"""Every query with SQL gives the rows that the SQL gives."""

import duckdb
import pytest

from quire.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple("None" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(df.select(cols).collect())
    if name in oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
        want = con.sql(oracle_sql()[name])
        assert sorted(want.columns) == cols
        assert got == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
