"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from typing import Any, Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage

#: A word is a run of anything but these six ASCII white-space bytes. ``bytes.split()`` cuts at the same six.
SPACES = " \t\n\x0b\x0c\r"

#: Characters of text handled at a time inside a task.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``limit`` bytes of text, so that Python objects stay few."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.binary_length(column).to_pylist()
    first, held = 0, 0
    for row, length in enumerate(lengths):
        held += length or 0
        if held >= limit:
            yield batch.slice(first, row + 1 - first)
            first, held = row + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    text: str = "text",
) -> DataFrame:
    """``mapInArrow`` with batches cut by bytes of text rather than by rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield function(part)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder: computed once, and kept if executors are lost."""
    return cut_lineage(df)


def tabled(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared checkpoint folder: like ``stored``, with unread columns left out."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task: the last thing asked for, so that memory holds one at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


#: Rows of one long that a broadcast may hold: 8 MB of keys.
BROADCAST_ROWS = 1_000_000


def without(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose long ``name`` isn't in ``keys``: by a broadcast if the keys are counted few, else a shuffle.

    Rows with a null stay.
    """
    keys = stored(keys.select(name).distinct())
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, name, "left_anti")


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS // 4) -> DataFrame:
    """A join with a stored table of fixed-width rows: by a broadcast if they are counted few, else a shuffle."""
    return df.join(F.broadcast(small) if small.count() <= limit else small, keys, how)
