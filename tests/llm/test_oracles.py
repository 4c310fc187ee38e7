"""The operators' SQL over whole tables."""

import duckdb
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name, sf):
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = queries.QUERIES[name](spark, data).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()
    assert list(got.columns) == list(want.columns)
    assert {c: t.kind for c, t in got.dtypes.items()} == {c: t.kind for c, t in want.dtypes.items()}
    both = [f.sort_values("doc_id").reset_index(drop=True) for f in (got, want)]
    for c in got.columns:
        assert (both[0][c] == both[1][c]).all(), c
