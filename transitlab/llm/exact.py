"""Exact dedup by distributed MSD radix partitioning: texts are told apart by their own bytes, without a digest.

1. Each task lower-cases A-Z and lets equal texts that it meets itself stand for
   one another (a local class), so a group of copies of any size has few members in
   what follows. Rows and texts are written once to the shared folder.
2. A digit is a run of bytes. All members of a group are split by their next digit;
   a group is a text's path of digits so far. Only the digits are shuffled, counted
   before and after. A group of one is done. A group whose members have ended is a
   set of equal texts. Any other group goes on, with digits four times as wide.
3. As soon as a group's texts fit into a task, one task splits it to the end by the
   same steps. Larger groups (a prefix that a third of all texts share) go on as in
   2, so no task ever holds one; the members of hot groups find their group by a
   broadcast of at most ``HOT_GROUPS`` rows.
4. Members of equal sets are added up, and rows look up their set by local class.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, slices, stored, tabled

#: Bytes of the first digit.
WIDTH = 16
#: Bytes of texts that a task remembers for local classes.
LOCAL_BYTES = 32_000_000
#: Members and bytes that a group may have to be split in one task.
TASK_MEMBERS, TASK_BYTES = 2_000, 8_000_000
#: Groups with more than 1 / HOT_GROUPS of all members (and HOT_ROWS at least) are hot.
HOT_GROUPS, HOT_ROWS = 500, 10_000

ROWS = "row long, member long, doc_id long, sha string, text binary"


def local_classes(docs: DataFrame, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """A row for each document: its number, its local class (the row that stands for it), and, there, the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, held = TaskContext.get().partitionId() << 33, {}, 0
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(*(column.to_pylist() for column in part.columns)):
                    raw = text.encode().lower() if text else b""  # of bytes, only A-Z are lower-cased
                    known = seen.get(raw)
                    if known:
                        rows.append((number, known[0], doc_id, known[1], None))
                    else:
                        seen[raw] = number, hashlib.sha256(raw).hexdigest()
                        held += len(raw)
                        rows.append((number, number, doc_id, seen[raw][1], raw))
                    number += 1
                columns = map(pa.array, zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["row", "member", "doc_id", "sha", "text"])
                if held > local_bytes:
                    seen, held = {}, 0

    return docs.mapInArrow(run, ROWS)


def equal_sets(texts: list[bytes], width: int) -> Iterator[list[int]]:
    """The places of equal texts, for each text that occurs twice or more: split by successive bytes."""
    todo = [(list(range(len(texts))), 0, width)]
    while todo:
        group, at, wide = todo.pop()
        split: dict[tuple[bytes, bool], list[int]] = {}
        for i in group:
            split.setdefault((texts[i][at : at + wide], len(texts[i]) <= at + wide), []).append(i)
        for (_, ended), own in split.items():
            if len(own) > 1 and ended:
                yield own
            elif len(own) > 1:
                todo.append((own, at + wide, 4 * wide))


def split_in_tasks(texts: DataFrame, width: int) -> DataFrame:
    """(member, equal): groups that fit into a task, split to the end. ``texts``: member, grp, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in slices(batch) for row in zip(*(c.to_pylist() for c in part.columns)))
        members, equal = [], []
        for _, group in groupby(rows, key=itemgetter(0)):
            own = list(group)
            for same in equal_sets([row[2] for row in own], width):
                numbers = [own[i][1] for i in same]
                members += numbers
                equal += [min(numbers)] * len(numbers)
            if len(members) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(equal)], ["member", "equal"])
                members, equal = [], []
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(equal, pa.int64())], ["member", "equal"])

    dealt = texts.select("grp", "member", "text").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "member long, equal long")


def split_once(texts: DataFrame, width: int, total: int) -> DataFrame:
    """(member, grp, ended, n, bytes): members of the groups of two or more after one more digit. Texts don't move."""
    keys = ["old", "digit", "ended"]
    heads = texts.select(
        "member",
        F.col("grp").alias("old"),
        F.substring("text", 1, width).alias("digit"),
        (F.length("text") <= width).alias("ended"),
        F.length("text").alias("own"),
    )
    groups = stored(
        heads.groupBy(*keys)
        .agg(F.min("member").alias("grp"), F.count("*").alias("n"), F.sum("own").alias("bytes"))
        .where("n > 1")
    )
    is_hot = F.col("n") > max(HOT_ROWS, total // HOT_GROUPS)
    hot = groups.where(is_hot)
    if hot.isEmpty():
        found = join_small(heads, groups, keys)
    else:  # at most HOT_GROUPS rows
        rest = heads.join(F.broadcast(hot), keys, "left_anti")
        found = heads.join(F.broadcast(hot), keys).unionByName(join_small(rest, stored(groups.where(~is_hot)), keys))
    return stored(found.select("member", "grp", "ended", "n", "bytes"))


def equal_members(texts: DataFrame, width: int, task_members: int, task_bytes: int) -> DataFrame:
    """(member, equal) for each member whose text another member has: ``equal`` is the least of them.

    ``texts`` (member, text) is a stored table with one row for each member.
    """
    total, found = texts.count(), []
    texts = texts.withColumn("grp", F.lit(0).cast("long"))
    while True:
        now = split_once(texts, width, total)
        found.append(now.where("ended").select("member", F.col("grp").alias("equal")))
        fits = (F.col("n") <= task_members) & (F.col("bytes") <= task_bytes)
        open_ = now.where("not ended").select("member", "grp", fits.alias("fits"))
        later = join_small(texts.drop("grp"), open_, ["member"]).withColumn(
            "text", F.expr(f"substring(text, {width + 1})")
        )
        found.append(split_in_tasks(later.where("fits"), width))
        if open_.where("not fits").isEmpty():
            break
        texts = tabled(later.where("not fits").select("member", "text", "grp"))
        width *= 4
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    return stored(every)


def exact_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    local_bytes: int = LOCAL_BYTES,
    task_members: int = TASK_MEMBERS,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; a null
    text counts as empty. Of equal texts the row with the greatest id stays; of rows
    that share this id, one. A null id is below all others, and ``keep_id`` is null
    only where a group has no other id. Other columns are not read. An empty table
    gives no rows.
    """
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    rows = tabled(local_classes(plain, local_bytes))
    equal = equal_members(rows.where("text is not null").select("member", "text"), width, task_members, task_bytes)
    members = rows.groupBy("member").agg(
        F.count("*").alias("n"),
        F.max("doc_id").alias("top"),
        F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("top_row"),
    )
    members = join_small(members, equal, ["member"], "left").withColumn("equal", F.coalesce("equal", "member"))
    sets = (
        members.groupBy("equal")
        .agg(
            F.sum("n").alias("group_size"),
            F.max("top").alias("keep_id"),
            F.coalesce(F.max_by("top_row", "top"), F.max("top_row")).alias("keep_row"),
        )
        .where("group_size > 1")
    )
    copies = stored(members.select("member", "equal").join(sets, "equal").drop("equal"))
    return join_small(rows.drop("text"), copies, ["member"], "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), grouped AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
