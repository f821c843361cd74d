import duckdb
import pytest

from tidemark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries()[name](spark, sf_small)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in found.fetchall())
