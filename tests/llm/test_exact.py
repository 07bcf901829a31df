import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transitlab.llm import exact
from transitlab.llm.exact import equal_sets, exact_copies

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, keep_id, size, kept, digest) of (doc_id, text) rows, as a sorted list."""
    groups, out = defaultdict(list), []
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        left = True
        for i in ids:
            out.append((i, keep, len(ids), left and i == keep, hashlib.sha256(text.encode()).hexdigest()))
            left = left and i != keep
    return sorted(out, key=str)


def result(df, **options):
    return sorted(map(tuple, exact_copies(df, **options).collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_whole_table(spark, documents):
    assert result(documents.repartition(5)) == brute(pairs(documents))


@pytest.mark.parametrize("options", [{}, {"width": 1, "local_bytes": 0, "task_bytes": 0}, {"width": 3, "task_members": 2}])
def test_edges(edge, clashing, empty, options):
    want = brute(pairs(edge))
    assert result(edge, **options) == want
    assert result(clashing, **options) == want
    assert result(empty, **options) == []


def test_long_shared_prefixes_and_hot_groups(spark, monkeypatch):
    """Groups that no task may hold are split by further digits; the hot ones by a broadcast."""
    monkeypatch.setattr(exact, "HOT_ROWS", 20)
    monkeypatch.setattr(exact, "HOT_GROUPS", 10)
    rows = [(i, "same start " * 30 + str(i % 90)) for i in range(300)] + [(1000 + i, "Copy" * (i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for options in ({"local_bytes": 0, "task_members": 0}, {"task_bytes": 1_000, "width": 4}):
        assert result(df, **options) == brute(rows)


def test_only_ascii_is_lower_cased(spark):
    rows = [(1, "ÄB"), (2, "Äb"), (3, "äb"), (4, "K"), (5, "K")]  # the last is the Kelvin sign
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=20), st.integers(1, 4))
def test_sets_split_by_bytes(texts, width):
    want = defaultdict(list)
    for i, text in enumerate(texts):
        want[text].append(i)
    assert sorted(equal_sets(texts, width)) == sorted(v for v in want.values() if len(v) > 1)
