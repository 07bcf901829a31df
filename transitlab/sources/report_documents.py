"""Report documents of any size (S11): one JSON document is parsed by as many tasks as it has splits.

A document is ``{"rows": [{...}, ...], "timestamp": ...}`` or a bare list of rows;
the list of rows is its only list of objects. A reader cuts files at every ``}``,
wherever a split begins. Whether such a cut ends a row depends on all that stands
before it: an odd number of quotes means that it lies in a string, and the depth of
open brackets says what it closes.

1. Each split adds up its marks twice: as if it began outside a string, and within.
2. A window over one row a split (quotes before it are even or odd, and so which of
   its sums holds) gives the state at the start of each split.
3. Each split is read again from its state and gives whole rows as they end. The
   texts before its first end and after its last one are fragments of rows that
   cross splits: at most two a split, put together by their order.
"""

from __future__ import annotations

import re
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: A document that is a bare list of rows begins so.
BARE = re.compile(rb"[ \t\n\x0b\f\r]*\[")

#: Splits whose states are broadcast (128 TB in splits of 128 MB); beyond it, texts are shuffled by split.
BROADCAST_SPLITS = 1_000_000


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, piece): the text between two ``}``, in the order of ``at`` within a split."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Each batch cut into runs of rows of one split, with its file and block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        changes = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield file[start].as_py(), block[start].as_py(), batch.slice(start, end - start)


def _text(run: pa.RecordBatch) -> pa.Buffer:
    """The text of a run: its pieces, each with the ``}`` at which it was cut."""
    end, nothing = pa.scalar(b"}", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    whole = pc.binary_join_element_wise(run.column("piece").cast(pa.large_binary()), end, nothing)
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    return whole.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))


def _marks(text: pa.Buffer) -> tuple[int, dict[bytes, np.ndarray], dict[bytes, np.ndarray]]:
    """The number of quotes, and where each bracket stands, after an even number of quotes and after an odd one.

    A quote after an odd number of backslashes is escaped."""
    chars = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(chars == ord('"'))
    slashes = np.flatnonzero(chars == ord("\\"))
    if len(slashes):
        starts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        lengths = np.diff(starts, append=len(slashes))
        escaped = (slashes[starts] + lengths)[lengths % 2 == 1]
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    even, odd = {}, {}
    for mark in (b"{", b"}", b"[", b"]"):
        places = np.flatnonzero(chars == ord(mark))
        within = np.searchsorted(quotes, places) % 2 == 1
        even[mark], odd[mark] = places[~within], places[within]
    return len(quotes), even, odd


SUMS = "file string, block long, quotes long, braces_out long, braces_in long, brackets_out long, brackets_in long, bare boolean"


def _record(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    named = [x.split() for x in columns.split(", ")]
    values = list(zip(*rows)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, named)], [n for n, _ in named])


def _bracket_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: quotes, and braces and brackets for either state at its start; whether it begins a bare list."""
    key, own, bare = None, None, False
    for file, block, run in _runs(batches):
        text = _text(run)
        if (file, block) != key:
            if key:
                yield _record([(*key, *own, bare)], SUMS)
            key, own, bare = (file, block), [0] * 5, block == 0 and BARE.match(text) is not None
        quotes, *sides = _marks(text)
        for side, found in enumerate(sides):
            state = (own[0] + side) & 1
            own[1 + state] += len(found[b"{"]) - len(found[b"}"])
            own[3 + state] += len(found[b"["]) - len(found[b"]"])
        own[0] += quotes
    if key:
        yield _record([(*key, *own, bare)], SUMS)


def split_states(text: DataFrame) -> DataFrame:
    """(file, block, bare, quoted, braces, brackets): the state in which each split begins."""
    sums = text.select("file", "block", "piece").mapInArrow(_bracket_sums, SUMS)
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    known = sums.withColumn("quoted", quoted).withColumn("bare", F.max("bare").over(whole))
    for kind in ("braces", "brackets"):
        known = known.withColumn(f"own_{kind}", F.when(F.col("quoted"), F.col(f"{kind}_in")).otherwise(F.col(f"{kind}_out")))
    return known.select(
        "file", "block", "bare", "quoted",
        F.coalesce(F.sum("own_braces").over(before), F.lit(0)).alias("braces"),
        F.coalesce(F.sum("own_brackets").over(before), F.lit(0)).alias("brackets"),
    )


CUT = "file string, block long, place int, whole boolean, row string"


def _cut_rows(batches: Iterable[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
    """Whole rows (``inner``, ``place`` 1), or of each split the text up to its first row's end (0) and after its last (2)."""
    key, held, ended, state, base = None, b"", False, None, 0

    def rest() -> list[tuple]:
        return [] if inner or key is None else [(*key, 2 if ended else 0, False, held.decode("utf-8", "replace"))]

    for file, block, run in _runs(batches):
        if (file, block) != key:
            if fragment := rest():
                yield _record(fragment, CUT)
            first = run.slice(0, 1).to_pydict()
            key, held, ended = (file, block), b"", False
            state, base = [first[k][0] for k in ("quoted", "braces", "brackets")], 0 if first["bare"][0] else 1
        text = _text(run)
        quotes, *sides = _marks(text)
        found = sides[1 if state[0] else 0]
        opened = {mark: np.searchsorted(found[mark], found[b"}"]) for mark in (b"{", b"[", b"]")}
        braces = state[1] + opened[b"{"] - np.arange(1, len(found[b"}"]) + 1)
        brackets = state[2] + opened[b"["] - opened[b"]"]
        ends = found[b"}"][(braces == base) & (brackets == 1)] + 1
        state = [
            state[0] != (quotes % 2 == 1),
            state[1] + len(found[b"{"]) - len(found[b"}"]),
            state[2] + len(found[b"["]) - len(found[b"]"]),
        ]
        if not len(ends):
            held += text.to_pybytes()
            continue
        if held:
            ends, text = ends + len(held), pa.py_buffer(held + text.to_pybytes())
        if not ended:
            if not inner:
                yield _record([(*key, 0, True, text.slice(0, int(ends[0])).to_pybytes().decode("utf-8", "replace"))], CUT)
            ended = True
        else:
            ends = np.concatenate([[0], ends])
        if inner and len(ends) > 1:
            n = len(ends) - 1
            rows = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64)), text]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(file, n), pa.repeat(block, n), pa.repeat(pa.scalar(1, pa.int32()), n), pa.repeat(True, n), rows],
                [x.split()[0] for x in CUT.split(", ")],
            )
        held = text.slice(int(ends[-1])).to_pybytes()
    if fragment := rest():
        yield _record(fragment, CUT)


def _whole_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_rows(batches, inner=True)


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_rows(batches, inner=False)


def document_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, opening, whole, row) of the texts put together from fragments, and of the rows that lie in one split.

    Together they are the text of every row, and of what follows the last one of each
    document (not whole). ``opening``: the text begins with the document's own
    beginning. The former, a few for each split, are stored; the latter are cut as they are read."""
    text = pieces(spark, path)
    states = split_states(text)
    # a row a split, stored: the sums over all pieces are made once
    states = cut_lineage(states)
    if states.count() <= BROADCAST_SPLITS:
        known = text.join(F.broadcast(states), ["file", "block"])
    else:
        known = text.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    known = known.select("file", "block", "piece", "bare", "quoted", "braces", "brackets")
    inner = known.mapInArrow(_whole_rows, CUT).select("file", F.lit(False).alias("opening"), "whole", "row")
    cut = known.mapInArrow(_fragments, CUT)
    # a fragment that ends a row closes what has been open since the end before it
    order = Window.partitionBy("file").orderBy("block", "place")
    ends = F.coalesce(F.sum(F.col("whole").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = (
        cut.withColumn("number", ends)
        .groupBy("file", "number")
        .agg(
            F.max("whole").alias("whole"),
            (F.min("block") == 0).alias("at_start"),
            F.sort_array(F.collect_list(F.struct("block", "place", "row"))).alias("parts"),
        )
    )
    crossing = crossing.select(
        "file",
        ((F.col("number") == 0) & F.col("at_start")).alias("opening"),
        "whole",
        F.concat_ws("", "parts.row").alias("row"),
    )
    return cut_lineage(crossing), inner


def read_report_documents(spark: SparkSession, path: str, row_schema: T.StructType) -> DataFrame:
    """The rows of all documents under ``path``, with the document's timestamp as ``run_ts`` (NULL if it has none).

    Escaped quotes and brackets within strings don't end a row. A document without
    rows gives none. Rows of a document of several splits come in no order."""
    crossing, inner = document_texts(spark, path)
    head = r'(?s)^\s*(?:\{.*?"rows"\s*:\s*)?\['
    row = F.when(F.col("opening"), F.regexp_replace("row", head, "")).otherwise(F.col("row"))
    texts = crossing.unionByName(inner)  # a document of one split keeps its order: only its first row ends a fragment
    parsed = texts.where("whole").select("file", F.from_json(F.regexp_replace(row, r"^[\s,]+", ""), row_schema).alias("r"))
    stamp = F.regexp_extract("row", r'"timestamp"\s*:\s*"([^"]*)"', 1)
    outside = F.when(F.col("whole"), F.regexp_extract("row", r'(?s)^(.*?)"rows"\s*:', 1)).otherwise(F.col("row"))
    stamps = (
        crossing.where("opening or not whole").withColumn("row", outside).select("file", F.nullif(stamp, F.lit("")).alias("run_ts"))
    ).groupBy("file").agg(F.max("run_ts").alias("run_ts"))
    few = stamps.count() <= BROADCAST_SPLITS  # a row a document
    return parsed.join(F.broadcast(stamps) if few else stamps, "file", "left").select("r.*", "run_ts")
