import random
import re

import numpy as np
import pytest
import xxhash

from transitlab.llm import simhash
from transitlab.llm.bktree import Forest, merge
from transitlab.llm.components import components
from transitlab.llm.queries import QUERIES


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius):
    """rows: (doc_id, fp); the least id of each row's group by all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_is_brute_force(spark, small, documents):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in documents.collect()]
    want = {(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, slow_components(rows, 4))}
    assert set(map(tuple, QUERIES["op4_simhash_bktree"](spark, small).collect())) == want


@pytest.fixture(scope="module")
def crowd():
    """Dense groups of near fingerprints, chains and loners."""
    r = random.Random(7)
    values = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(60):
            values.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
        chain = base
        for _ in range(6):
            chain ^= sum(1 << b for b in r.sample(range(64), 4))
            values.add(chain)
    values |= {r.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    return sorted(values)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("mean_shard, tree_size", [(4096, 8192), (4096, 16), (1, 8192), (1, 4)])
def test_no_link_is_lost(spark, crowd, mean_shard, tree_size, monkeypatch):
    fps = spark.createDataFrame([(signed(x),) for x in crowd], "fp long").repartition(3)
    found = {r.node: r.label for r in components(simhash.links(fps, 4, mean_shard, tree_size)).collect()}
    groups = slow_components([(i, x) for i, x in enumerate(crowd)], 4)
    labels = [found.get(signed(x), signed(x)) for x in crowd]
    assert len(set(zip(groups, labels))) == len(set(groups)) == len(set(labels))


def test_shards_over_many_batches(crowd, monkeypatch):
    """Shards that go on in the next batch: queries wait for all tree members, and members stay for later queries."""
    import pyarrow as pa

    rows = []
    for shard in range(5):
        own = crowd[shard * 100 : shard * 100 + 150]
        rows += [(0, shard, 0, 0, signed(x)) for x in own[:40]] + [(0, shard, 0, 1, signed(x)) for x in own[40:]]
    rows.append((0, 9, 0, 1, 5))  # queries without a tree

    def run(size):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], list("abcde"))
            for i in range(0, len(rows), size)
        ]
        out = [(u, v) for b in simhash.shard_links(batches, 4) for u, v in zip(*(c.to_pylist() for c in b.columns))]
        nodes = {x: i for i, x in enumerate({r[4] for r in rows})}
        label = merge(np.arange(len(nodes)), *(np.array([nodes[e[i]] for e in out]) for i in (0, 1)))
        return [label[nodes[x]] for x in nodes]

    whole = run(len(rows))
    for rows_each in (16, 64):
        monkeypatch.setattr(simhash, "BATCH_ROWS", rows_each)
        assert run(7) == whole


def test_tree_finds_what_a_scan_finds(crowd):
    values = np.array(crowd, np.uint64)
    np.random.default_rng(1).shuffle(values)
    roots = np.zeros(len(values), np.int64)
    query, node = Forest.build(values, roots).search(values, roots, 4)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    assert len(query) == near.sum() and near[query, node].all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 199)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(edge, empty, clashing):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in edge.collect()]
    want = sorted(((d, signed(fp), c) for (d, fp), c in zip(rows, slow_components(rows, 4))), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(edge).collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c in want if d is not None and d == c})
    assert ids.count(None) == 2
