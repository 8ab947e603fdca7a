import duckdb
import pytest

from sparkledger.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = QUERIES[name](spark, DATA)
    done = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(repr, done.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
