"""The queries that SQL can express against it, on whole tables."""

import duckdb
import pytest

from marginalia.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = duck.sql(ORACLES[name])
    df = QUERIES[name](spark, SF).select(*want.columns)
    plain = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert sorted(want.columns) == sorted(QUERIES[name](spark, SF).columns)
    assert plain(df.collect()) == plain(want.fetchall())
