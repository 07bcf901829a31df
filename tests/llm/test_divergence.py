import re
from collections import Counter, defaultdict

import pytest

from transitlab.llm.divergence import divergence, share

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=10, first=10):
    docs, counts, langs = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        words = TERM.findall((text or "").translate(UPPER))
        counts.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in langs.items():
        kept = [w for (own, w), n in docs.items() if own == lang and n >= least_docs]

        def shares(of):
            n = {w: sum(counts[lang, s, w] for s in of) for w in kept}
            total = sum(n.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (n[w] + 2) // total for w in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        whole, own = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            found = [(-sum(apart(own[s][w], own[t][w]) for w in kept), t.encode()) for t in sources if t != s]
            typical = [
                (-apart(own[s][w], whole[w]), w.encode()) for w in kept if counts[lang, s, w] and own[s][w] > whole[w]
            ]
            for part, items in (("pair", sorted(found)), ("term", sorted(typical)[:first])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def triples(df):
    return [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]


def result(df, **options):
    return sorted(map(tuple, divergence(df, **options).collect()))


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties, terms that differ by case alone, sources without terms, a language of one source, one hot source."""
    words = "alpha beta Beta gamma delta épée été 漢字 zeta eta theta iota kappa".split()
    rows = []
    for i in range(160):
        text = " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9)) + f" x{i}y, z_{words[i % 3]}"
        rows.append((["en", "en", "de", None][i % 4], ["a", "b", "c", None, "hot", "hot", "hot"][i % 7], text))
    rows += [("fr", "only", "alpha"), ("en", "none", None), ("en", "empty", ""), ("none", "a", "1 2"), ("none", "b", None)]
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)


def test_brute_force(mixed):
    rows = triples(mixed)
    assert result(mixed) == brute(rows)
    assert result(mixed, least_docs=3, first=2) == brute(rows, 3, 2)


def test_colliding_digests_are_split(mixed):
    """Digests of two bits: nearly all terms collide."""
    assert result(mixed, bits=2) == brute(triples(mixed))


def test_blocks_cells_and_memory(mixed):
    assert result(mixed, held=5, block=2, cell=3) == brute(triples(mixed))


def test_edges(edge, clashing, empty):
    want = brute(triples(edge), 2)
    assert result(edge, least_docs=2) == want
    assert result(clashing.drop("at").withColumnRenamed("row", "n"), least_docs=2) == want
    assert result(empty) == []


def test_whole_table(spark, documents):
    assert result(documents) == brute(triples(documents))


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**18, 3 * 10**18, 7), (9_007_199_254_740_993, 9_007_199_254_740_999, 10**9), (0, 0, 1)]
    df = spark.createDataFrame(rows, "n long, total long, size long")
    got = [r.p for r in df.select(share(F.col("n"), F.col("total"), F.col("size")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]
