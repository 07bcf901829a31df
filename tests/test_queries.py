"""The library's registered queries against the DuckDB oracle at sf0.001, the flagship
entry, and the file-drop stream."""

import math

import duckdb
import pytest

from sample_paths import SF0001

from __spark_entry__ import ROWS_ONLY
from oracle import ORACLE
from transitlab.plans.queries import registry
from transitlab.plans.source_queries import source_registry
from transitlab.plans.store_queries import store_registry

LIBRARY = sorted(ORACLE.keys() - ROWS_ONLY)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, repr(v)) if isinstance(v, float) else (2, str(v))


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "nation", "region", "supplier"):
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", LIBRARY)
def test_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF0001)
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_rows_only():
    from __spark_entry__ import ROWS_ONLY, oracle_sql, queries

    library = set(registry()) | set(store_registry()) | set(source_registry())
    assert library <= set(queries()) and library - set(oracle_sql()) == ROWS_ONLY


def test_entry(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{SF0001}/lineitem.parquet").count()


def test_stream_runs_each_file_once(spark):
    from __spark_entry__ import queries

    out = queries()["file_drop_stream"](spark, SF0001)
    n = spark.read.parquet(f"{SF0001}/lineitem.parquet").count()
    assert out.count() == n  # the restart with the same checkpoint added nothing
