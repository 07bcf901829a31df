import hashlib

import pytest
from pyspark.sql import functions as F

from transitlab.llm import substring
from transitlab.llm.queries import QUERIES


def brute(rows, window):
    """(doc_id, text) -> (n_words, n_removed, kept words) by every window of every document."""
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        stays = [True] * len(words)
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            if first[tuple(words[i : i + window])] < doc_id:
                stays[i : i + window] = [False] * window
        kept = b" ".join(w for w, s in zip(words, stays) if s).decode()
        out.append((doc_id, len(words), stays.count(False), kept))
    return sorted(out, key=str)


def found(docs, **how):
    rows = substring.remove_repeats(docs, **how).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(map(tuple, rows), key=str)


def test_query_is_brute_force(spark, small, documents):
    want = {
        r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest())
        for r in brute([(r.doc_id, r.text) for r in documents.collect()], 50)
    }
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_phrase_automata"](spark, small).collect()}
    assert got == want and any(n for _, n, _ in want.values())


@pytest.fixture(scope="module")
def passages(spark):
    """Texts that share passages in many ways: whole, in part, edited, overlapping, repeated within and across."""
    import random

    r = random.Random(4)
    pool = [[f"w{r.randrange(40)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for doc_id in r.sample(range(200), 60):
        words = []
        for _ in range(r.randint(1, 4)):
            source = r.choice(pool)
            a = r.randrange(60)
            part = source[a : a + r.randint(10, 60)]
            if r.random() < 0.4:
                part = [f"e{doc_id}" if r.random() < 0.05 else w for w in part]
            words += part + [f"u{doc_id}x{r.randrange(9)}" for _ in range(r.randint(0, 4))]
        rows.append((doc_id, " ".join(words)))
    rows += [(300, "same " * 200), (301, "same " * 150 + "end"), (302, "other " + "same " * 70)]
    return rows


@pytest.mark.parametrize("part_phrases", [10, 20_000])
def test_shared_passages(spark, passages, part_phrases):
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(4)
    want = brute(passages, 20)
    assert found(docs, window=20, part_phrases=part_phrases) == want
    assert sum(r[2] for r in want) > 500


def test_edges(edge, empty, clashing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == brute(rows, 50)
    assert found(empty) == []
    out = substring.with_repeats_removed(clashing)
    assert out.columns == clashing.columns
    assert {r.n_words for r in out.collect()} == {"mine"}


def test_columns_follow_the_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, len(text)), (2, "start\n" + text, 1)], "doc_id long, text string, n_chars long")
    first, second = substring.with_repeats_removed(docs).orderBy("doc_id").collect()
    assert first.text == text
    assert (second.text, second.n_chars) == ("start", 5)
