"""The registered queries against DuckDB on the smallest tables, and what
holds for all of them."""

import duckdb
import pytest

from haat.llm.oracle import SQL
from haat.llm.queries import QUERIES
from haat.sources.tables import TABLES
from tests.llm import helpers


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{helpers.SF}/{t}.parquet')")
    return c


def flat(rows):
    return sorted((tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in rows),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, helpers.SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert flat(tuple(r) for r in df.collect()) == flat(want)


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
