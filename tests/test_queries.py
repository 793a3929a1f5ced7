"""Every query of the engine's own operators against its DuckDB SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from brindle.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    assert found
    if name in SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert rounded(found) == rounded(db.execute(f"SELECT {listed} FROM ({SQL[name]})").fetchall())


def test_registry():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "tag", "score", "rank"]
