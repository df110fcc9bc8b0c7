import pytest

from vantor.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(oracle_sql()) <= set(queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(map(repr, ([r[c] for c in columns] for r in df.collect())))
    assert got == sorted(map(repr, map(list, want.fetchall())))
