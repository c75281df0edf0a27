import duckdb
import pytest

from clauselake.llm.registered import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(map(str, row)) for row in result.fetchall())
    assert sorted(tuple(str(row[c]) for c in columns) for row in df.collect()) == expected
