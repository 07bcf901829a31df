"""Kept indexes over object ids: substring search (F3) and look-up of many ids.

Substring search: an inverted index of trigrams. ``ids`` holds each id once with a
number; ``postings`` holds every trigram of every id as (gram, numbers), a row for a
gram in a block of ids, in folders by a hash of the gram and sorted by gram within a
file, so a search opens the folders of its needles' grams and, in them, the row
groups that hold these grams; ``grams`` holds how many ids have each gram. A batch of
needles takes the postings of each needle's rarest gram, cuts their ids around that
gram in the lengths that its needles have, and looks the cuts up among the needles:
what a search costs follows the postings, not the postings times the needles.

Look-up: rows are clustered by id with Parquet Bloom filters, so a set of ids reads
the row groups that may hold one of them.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import number_rows

GRAM = 3
#: Folders of postings.
FOLDERS = 64
#: Ids, and characters, whose grams share a row of postings each.
BLOCK_IDS, BLOCK_CHARS = 100_000, 4_000_000
#: Needles that are broadcast to the texts cut from ids; more are joined by shuffle.
BROADCAST_NEEDLES = 1_000_000
#: Grams (or ids) of a batch that are passed to the scan as a list; larger batches are joined without it.
LISTED = 10_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none if it is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(
        F.array().cast("array<string>")
    )


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


POSTINGS = "gram string, numbers array<bigint>"
_CODE = 21  # bits of a code point


def _block_postings(numbers: list[int], texts: list[str]) -> pa.RecordBatch:
    """The ids of each trigram in a block: the codes of three characters in one number, sorted."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.array(numbers, np.int64), np.fromiter(map(len, texts), np.int64, len(texts)))
    if len(codes) < GRAM:
        codes, owner = np.zeros(GRAM, np.int64), np.arange(GRAM)  # no trigram
    packed = codes[:-2] << 2 * _CODE | codes[1:-1] << _CODE | codes[2:]
    inside = owner[:-2] == owner[2:]
    packed, owner = packed[inside], owner[:-2][inside]
    order = np.argsort(packed, kind="stable")  # an id's repeats of a gram stay side by side
    packed, owner = packed[order], owner[order]
    new_gram = np.diff(packed, prepend=-1) != 0
    once = new_gram | (np.diff(owner, prepend=-1) != 0)
    packed, owner, new_gram = packed[once], owner[once], new_gram[once]
    starts = np.flatnonzero(new_gram)
    found, mask = packed[starts], (1 << _CODE) - 1
    text = np.stack([found >> 2 * _CODE, found >> _CODE & mask, found & mask], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)), pa.int32()), pa.array(owner, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string()), lists], ["gram", "numbers"])


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (number, text) rows, block by block."""
    numbers, texts, chars = [], [], 0
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            numbers.append(number)
            texts.append(text)
            chars += len(text)
            if len(texts) >= BLOCK_IDS or chars >= BLOCK_CHARS:
                yield _block_postings(numbers, texts)
                numbers, texts, chars = [], [], 0
    if texts:
        yield _block_postings(numbers, texts)


def write_trigram_index(df: DataFrame, path: str, id_col: str = "object_id") -> None:
    """Writes the index of the distinct ids of a table; ids are compared in lower case. NULLs have no entry."""
    base = path.rstrip("/")
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    numbered = number_rows(ids.orderBy("id"), "number")
    numbered.write.mode("overwrite").parquet(f"{base}/ids")
    spark = df.sparkSession
    texts = spark.read.parquet(f"{base}/ids").select("number", F.lower("id").alias("text"))
    entries = texts.mapInArrow(_postings, POSTINGS).withColumns({"folder": _folder(F.col("gram")), "first": F.col("numbers")[0]})
    # sorted by gram and number over all tasks: a gram that all ids have fills many tasks
    entries.repartitionByRange("folder", "gram", "first").sortWithinPartitions("folder", "gram", "first").select(
        "gram", "numbers", "folder"
    ).write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{base}/postings")
    counts = spark.read.parquet(f"{base}/postings").groupBy("gram").agg(F.sum(F.size("numbers")).alias("ids"))
    counts.write.mode("overwrite").parquet(f"{base}/grams")


def search_index(spark: SparkSession, path: str, needles: DataFrame, needle_col: str = "needle") -> DataFrame:
    """(needle, object_id) for each id that contains the needle, whatever the case; an empty or NULL needle finds nothing.

    Needles are told apart by their text in lower case. One shorter than a trigram
    has no gram to look up and is held against all ids; so is none of the others."""
    base = path.rstrip("/")
    ids = spark.read.parquet(f"{base}/ids")
    words = cut_lineage(
        needles.select(F.lower(F.col(needle_col).cast("string")).alias("needle")).where("needle != ''").distinct()
    )
    asked = words.select("needle", F.explode(grams(F.col("needle"))).alias("gram"))
    # a gram that no id has still counts: with 0 postings it makes the intersection empty
    known = asked.join(spark.read.parquet(f"{base}/grams"), "gram", "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    order = Window.partitionBy("needle").orderBy("ids", "gram")
    # the rarest gram of each needle, with its place there
    keyed = known.withColumn("at", F.row_number().over(order)).where("at = 1 and ids > 0")
    keys = cut_lineage(keyed.select("gram", "needle", F.expr("instr(needle, gram) - 1").alias("before"), F.length("needle").alias("length")))
    shapes = keys.groupBy("gram").agg(F.collect_set(F.struct("before", "length")).alias("shapes"))
    likely = postings_of(spark, base, keys).join(shapes, "gram").join(ids, "number")
    text = F.lower("id")
    places = F.filter(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM)) == F.col("gram"))
    cuts = F.flatten(
        F.transform(places, lambda i: F.transform("shapes", lambda s: F.when(i > s["before"], F.substring(text, i - s["before"], s["length"]))))
    )
    cut = likely.select("gram", "id", F.explode(F.array_distinct(cuts)).alias("needle"))
    asked_for = keys.select("gram", "needle")
    likely = cut.join(F.broadcast(asked_for) if keys.count() <= BROADCAST_NEEDLES else asked_for, ["gram", "needle"])
    short = words.where(F.length("needle") < GRAM)
    rest = ids.join(F.broadcast(short), F.contains(F.lower("id"), F.col("needle")))
    return likely.select("needle", F.col("id").alias("object_id")).unionByName(rest.select("needle", F.col("id").alias("object_id")))


def postings_of(spark: SparkSession, base: str, asked: DataFrame) -> DataFrame:
    """The postings of the grams asked for. As many as ``LISTED`` reach the scan, as folders and as values."""
    postings = spark.read.parquet(f"{base}/postings")
    few = asked.select("gram").distinct().limit(LISTED + 1).collect()
    if len(few) > LISTED:
        return postings.join(asked.select("gram").distinct(), "gram", "left_semi").select("gram", F.explode("numbers").alias("number"))
    listed = [r["gram"] for r in few]
    # the hash is taken by Spark, of a table with one row a gram
    folders = [r[0] for r in asked.select(_folder(F.col("gram"))).distinct().collect()]
    return postings.where(F.col("folder").isin(folders) & F.col("gram").isin(listed)).select("gram", F.explode("numbers").alias("number"))


def write_clustered(
    df: DataFrame, path: str, id_col: str = "object_id", distinct_ids: int = 1_000_000, group_rows: int | None = None
) -> None:
    """Rows clustered by id, with Bloom filters on it (sized for ``distinct_ids`` in a row group).

    ``group_rows`` makes row groups of that many rows, where the format's own 128 MB
    are too coarse."""
    writer = df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{id_col}", True)
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{id_col}", group_rows or distinct_ids)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)


def lookup_objects(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "object_id") -> DataFrame:
    """all rows of the clustered table whose id is among ``ids`` (repeats and NULLs in them don't matter).

    Up to ``LISTED`` ids are passed to the scan as a list, which row groups are held
    against by their least and greatest id and their Bloom filter. A larger batch is
    joined, and the scan knows its least and greatest id."""
    rows = spark.read.parquet(path)
    wanted = cut_lineage(ids.select(F.col(id_col).cast("string").alias(id_col)).where(F.col(id_col).isNotNull()).distinct())
    few = wanted.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return rows.where(F.col(id_col).isin([r[0] for r in few]))
    low, high = wanted.agg(F.min(id_col), F.max(id_col)).first()
    return rows.where(F.col(id_col).between(low, high)).join(wanted, id_col, "left_semi")
