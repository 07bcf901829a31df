"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components.

Fingerprints link where at most ``radius`` bits differ. The 64 bits fall into n
blocks; two linked fingerprints agree on at least n - radius whole blocks, so each
choice of n - radius blocks makes shards of equal blocks, and every link lies
inside a shard. Each shard has its own BK-tree, and its members search it. n grows
with the number of distinct fingerprints such that a mean shard keeps below a
fixed size; any n finds every link. A shard with more members than ``tree_size``
is split into that many trees by a hash, and each tree is sent to where the
queries of the shard go, so no task holds a whole hot group. Shards return
spanning links only, at most one for each query and one for each tree member,
never the pairs of a group.
"""

from __future__ import annotations

import itertools
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, merge
from .common import map_slices, stored, without
from .components import components

SEED = 42

#: Rows of shards that a task takes up at a time, about.
BATCH_ROWS = 65_536

#: Pairs of query and node that a search holds at most at a time, about.
FRONTIER = 4_000_000


def shingles(text: str | None, size: int) -> list[bytes]:
    """The word shingles of a text in lower case (A-Z only), repeats included; the whole sequence if it is shorter."""
    words = text.encode().lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: str | None, size: int) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; zero for a text without words."""
    parts = shingles(text, size)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), "<u8", len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each document; fp is the fingerprint's bits as a long. Null texts have no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(text, shingle) for text in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the blocks, as a signed long."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(count: int, radius: int, mean_shard: int) -> int:
    """The fewest blocks that leave ``mean_shard`` fingerprints or fewer in a shard of evenly spread ones."""
    blocks = radius + 1
    while count / 2 ** (64 * (blocks - radius) // blocks) > mean_shard and blocks < 32:
        blocks += 1
    return blocks


def shard_links(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links (u, v) of whole shards; rows (shard, tree, fp) come sorted, tree members before queries."""
    kept: list[np.ndarray] = []

    def links(shard: np.ndarray, tree: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, (shard[1:] != shard[:-1]).any(axis=1)]
        root = np.flatnonzero(first)[np.cumsum(first) - 1]
        several = (np.bincount(root, minlength=len(root))[root] > 1) & tree[root]
        shard, tree, fp, root = shard[several], tree[several], fp[several], root[several]
        root = np.searchsorted(np.flatnonzero(several), root)
        members = np.flatnonzero(tree)  # in sorted order: each shard's members come first
        place = np.cumsum(tree) - 1
        forest = Forest.build(fp[members], place[root][members])
        label = np.arange(len(fp))
        sizes = np.bincount(place[root][members], minlength=len(members))[place[root]]
        at = 0
        while at < len(fp):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), FRONTIER)) + at)
            query, node = forest.search(fp[at:upto], place[root[at:upto]], radius)
            label = merge(label, query + at, members[node])
            at = upto
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], ["u", "v"]
        )

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            kept.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]))
            if sum(map(len, kept)) < BATCH_ROWS:
                continue
        if not kept:
            return
        rows = np.concatenate(kept)
        upto = len(rows)
        carried = rows[upto:]
        if batch is not None:  # the last shard may go on: its tree members stay, and queries wait until all are there
            last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0])
            carried = rows[last:][rows[last:, 3] == 0]
            upto = last if rows[-1, 3] == 0 else len(rows)
        kept = [carried]
        if upto:
            some = rows[:upto]
            yield links(some[:, :3], some[:, 3] == 0, np.ascontiguousarray(some[:, 4]).view(np.uint64))


def links(fps: DataFrame, radius: int, mean_shard: int = 4096, tree_size: int = 8192) -> DataFrame:
    """(u, v): links of distinct fingerprints that connect all that lie within ``radius`` bits."""
    masks = block_masks(blocks_for(fps.count(), radius, mean_shard), radius)
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
        ).alias("shard"),
    ).select("shard.choice", "shard.key", "fp")
    hot = (
        keyed.groupBy("choice", "key")
        .agg(F.ceil(F.count("*") / tree_size).alias("trees"))
        .where("trees > 1")
    )
    split = keyed.join(hot, ["choice", "key"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("trees"))
    members = split.select("choice", "key", own.alias("part"), F.lit(0).cast("long").alias("role"), "fp")
    queries = (
        split.where("trees > 1")
        .select("choice", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("part"))
        .where("part != own")
        .select("choice", "key", "part", F.lit(1).cast("long").alias("role"), "fp")
    )
    shards = members.union(queries).repartition("choice", "key", "part")
    return shards.sortWithinPartitions("choice", "key", "part", "role", "fp").mapInArrow(
        lambda batches: shard_links(batches, radius), "u long, v long"
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows give a row each. A null doc_id takes part through its fingerprint;
    component_id is null only where no document reachable has an id. An empty
    table gives no rows. Other columns are not read.
    """
    found = stored(fingerprints(docs, shingle))
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(least.select("fp"), radius))
    classes = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    return found.join(classes.join(lowest, "label").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents with the least doc_id of their group, with all their columns; one row of those that share an id.

    Rows with a null doc_id can't be told apart by id and stay.
    """
    found = stored(near_duplicates(docs, shingle, radius))
    kept = without(docs, found.where("doc_id != component_id"), "doc_id")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return without(kept, repeated, "doc_id").unionByName(once).select(*docs.columns)
