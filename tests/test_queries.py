"""Every query that has SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        files = [p] if os.path.isfile(p) else glob.glob(p + "/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def rows(names, data):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(norm(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    data = got.collect()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, data) == rows(names, want.fetchall())
    else:
        assert data
