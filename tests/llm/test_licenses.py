import duckdb
import pytest

from transitlab.llm import licenses
from transitlab.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "unit", "number", "license", "dice"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).toPandas().itertuples(index=False, name=None))


def in_duckdb(source):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS {source}")
    return sorted(con.sql(ORACLES["op10_license_dice"]).df()[COLUMNS].itertuples(index=False, name=None))


def test_query_is_the_sql(spark, small):
    got = rows_of(QUERIES["op10_license_dice"](spark, small))
    assert got and got == in_duckdb(f"SELECT * FROM '{small}/documents.parquet'")


def test_templates_are_found_in_any_wrapping(spark):
    rows = []
    for i, (name, texts) in enumerate(sorted(licenses.TEMPLATES.items())):
        for j, text in enumerate(texts):
            words = text.split()
            wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
            rows.append((100 * i + j, f"Some title\n\n{wrapped.upper()}\n\nAnd a text that says other things."))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    names = sorted(licenses.TEMPLATES)
    best = {}
    for r in found.collect():
        best.setdefault(r.doc_id, {})[r.license] = r.dice
    for doc_id, _ in rows:
        assert best[doc_id][names[doc_id // 100]] == 1.0


@pytest.mark.parametrize("size", [1, 2, 7, 60])
@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_bounds_prune_nothing_that_can_reach(size, least):
    low, high = licenses.bounds(size, least)
    for a in range(1, 4 * size + 2):
        reachable = 2 * min(a, size) / (a + size) >= least
        assert reachable == (low <= a <= high)


def test_plan_stays_in_the_engine(spark, small):
    plan = QUERIES["op10_license_dice"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_edges(spark, edge, empty, clashing):
    extra = spark.createDataFrame(
        [(20, "Released under the MIT License."), (20, "Released under the MIT License."), (None, "\n\nAll rights\nreserved.\n\n")],
        "doc_id long, text string",
    )
    docs = edge.select("doc_id", "text").union(extra)
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    assert got.count((20, "line", 1, "MIT", 1.0)) == 2
    assert (None, "paragraph", 2, "LicenseRef-all-rights-reserved", 1.0) in got
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(clashing).count() == licenses.scan(edge).count()
