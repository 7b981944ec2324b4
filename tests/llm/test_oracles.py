import duckdb
import pytest

from gridtrack.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert text(got) == text(want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
