import duckdb
import pytest

from sparkledger.plans import inputs  # noqa: F401  registers its queries
from sparkledger.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", [n for n, f in QUERIES.items() if next(k for k, g in QUERIES.items() if g is f) == n])
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    rows = out.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    done = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted(tuple(map(plain, r)) for r in done.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "sparkledger"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
