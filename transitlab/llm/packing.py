"""Harmonic packing of documents into sequences of a fixed capacity.

Whole capacities are cut off a document and are sequences of their own. Its rest is
one piece, in the reciprocal-capacity class k with capacity / (k + 1) < length <=
capacity / k, and a bin of class k is closed to rests at k of them, whatever the
other classes hold. Harmonic packing would pad what is then left of the bin, at most
a share of 1 / (k + 1); here documents may be cut, so the next rest gives the bin its
beginning, and only what goes on is classed. So a document is cut but for its whole
capacities and where it fills such a gap, and no sequence is padded.

Each worker fills its classes' bins from the rows it reads; there is no shuffle, and
nothing is kept but the open bins, less than one capacity of ids for each class. What
is left open when a worker ends is put end to end and cut into full sequences, the
last of them into fills that are powers of two, which need no padding either.

Sequence ids hold the partition and a counter in it, so they are unique without
any exchange between workers. A task that runs again makes whole sequences again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .tokens import encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, class int"
)
ARROW = pa.schema(
    [(x, pa.int64()) for x in "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()]
    + [("class", pa.int32())]
)


Piece = tuple  # (doc_id, start, ids as bytes, doc_tokens)


def class_of(length: int, capacity: int) -> int:
    """The k with capacity / (k + 1) < length <= capacity / k."""
    return capacity // length


@dataclass
class Bins:
    """The open bins of one worker: of each class, and those that have all their rests but a gap."""

    capacity: int
    first_id: int
    rows: dict[str, list] = field(default_factory=dict)

    def __post_init__(self):
        self.open: dict[int, list[Piece]] = {}
        self.gap: tuple[int, list[Piece]] | None = None  # ids that are missing, and the pieces
        self.sequences = 0
        self.clear()

    def clear(self) -> None:
        self.rows = {name: [] for name in ARROW.names}

    def write(self, pieces: list[Piece]) -> None:
        """One sequence of these pieces, gapless from 0."""
        offset, r = 0, self.rows
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            r["doc_id"].append(doc_id)
            r["start"].append(start)
            r["length"].append(length)
            r["ids_crc32"].append(zlib.crc32(ids))
            r["doc_tokens"].append(total)
            r["sequence_id"].append(self.first_id + self.sequences)
            r["offset"].append(offset)
            r["class"].append(class_of(length, self.capacity))
            offset += length
        self.sequences += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start, whole = len(ids) // 4, 0, 4 * self.capacity
        while total - start >= self.capacity:
            self.write([(doc_id, start, ids[4 * start : 4 * start + whole], total)])
            start += self.capacity
        while start < total and self.gap:
            missing, pieces = self.gap
            last = min(total, start + missing)
            pieces.append((doc_id, start, ids[4 * start : 4 * last], total))
            missing, start = missing - (last - start), last
            self.gap = (missing, pieces) if missing else self.write(pieces)
        if start < total:
            k = class_of(total - start, self.capacity)
            waiting = self.open.setdefault(k, [])
            waiting.append((doc_id, start, ids[4 * start :], total))
            if len(waiting) == k:  # closed to rests; there is no other gap, or this rest would have filled it
                missing = self.capacity - sum(len(piece[2]) for piece in waiting) // 4
                self.gap = (missing, waiting) if missing else self.write(waiting)
                self.open[k] = []

    def close(self) -> None:
        """What is open, end to end: full sequences, and then fills that are powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]] + (self.gap[1] if self.gap else [])
        self.open, self.gap = {}, None
        left = sum(len(piece[2]) for piece in rest) // 4
        while left:
            room = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left, held, taken = left - room, 0, []
            while held < room:
                doc_id, start, ids, total = rest.pop()
                fits = min(room - held, len(ids) // 4)
                taken.append((doc_id, start, ids[: 4 * fits], total))
                held += fits
                if 4 * fits < len(ids):
                    rest.append((doc_id, start + fits, ids[4 * fits :], total))
            self.write(taken)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.rows, schema=ARROW)
        self.clear()
        return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The pieces of all documents, packed into sequences of ``capacity`` tokens.

    A document is the ids of its text and then ``end_id``. A null or empty text
    has the end id alone. Rows that repeat an id or a text are documents of their
    own; a null id stays null. Other columns are not read. An empty table gives no
    pieces. All sequences are full but the last ones of a worker, whose fills are
    powers of two. ``class`` is the reciprocal-capacity class of the piece's length.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch):
                ids, texts = (column.to_pylist() for column in part.columns)
                for doc_id, text in zip(ids, texts):
                    bins.add(doc_id, encode(text) + end)
                yield bins.batch()
        bins.close()
        yield bins.batch()

    return docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")).mapInArrow(
        run, PIECES
    )
