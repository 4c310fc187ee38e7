"""Every query against its SQL in DuckDB, by columns and values in any order."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if x is None or x != x else round(x, 5) if isinstance(x, float) else x for x in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].isna().any() and got[c].dtype.kind == "f":  # pandas has integers with nulls as floats
            want[c] = want[c].astype(float)
        assert got[c].dtype.kind == want[c].dtype.kind, c
    assert normal(got) == normal(want)


def test_pass_counts_of_large_keys(spark, tmp_path):
    """Beyond 16^5 the SQL still has 5; a missing key, too."""
    keys = [None, *(k + i for k in (1, 16, 256, 4096, 65536, 16**5, 2**31) for i in (-1, 0, 1))]
    spark.createDataFrame([(k, 1.5) for k in keys], "p_partkey bigint, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = registry.QUERIES["pass_counts"](spark, str(tmp_path)).select("p_partkey", "p_retailprice", "below", "passes").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(registry.ORACLE_SQL["pass_counts"]).fetchall(), key=repr)
    assert {r.passes for r in got} == {0, 1, 2, 3, 4, 5}


#: Products with 10^6 or 10^5 that are ties, though the numbers are not, or the reverse.
TIES = {"distance_matrix": (0.0, 2.0140985, 4.0796575, 1.3647974999999999), "distance_matrix_64": (0.0, 2.384965, 4.411795, 1.9818449999999999)}


@pytest.mark.parametrize("name", sorted(TIES))
def test_distances_at_ties(spark, tmp_path, name):
    """Distances are rounded as the SQL rounds them, to the last bit; NaN, infinite and huge ones, too, and missing ones where the SQL takes them."""
    rows = [*TIES[name], 1e200, float("inf"), float("nan"), *[None] * (name == "distance_matrix")]
    spark.createDataFrame([(i, [x] + [0.0] * 63) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path)).select("i", "j", "d").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(registry.ORACLE_SQL[name]).fetchall()))
