"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of the whole text; a chunk ends where its
upper bits are zero. Chunking is normalised: up to the normal size more bits have
to be zero than after it, so sizes keep close to it, between a least and a greatest
size. A fingerprint is the set of the chunks' digests, each with its chunk's
length as its weight. Boundaries move with the text, so a passage that is shifted
keeps its chunks, and the weight shared says how much of one text is in another.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices

#: A number for each byte, by a rule: the hash of the byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)

#: Bytes that the rolling hash takes up at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; the greatest is below 256, as a length has two hexadecimal digits in a fingerprint."""

    least: int = 8
    normal: int = 32
    greatest: int = 128
    strict_bits: int = 7
    loose_bits: int = 3

    def candidates(self, raw: np.ndarray) -> tuple[list[int], list[int]]:
        """Where a chunk may end before, and after, it has its normal size."""
        strict, loose = [], []
        for at in range(0, len(raw), BLOCK):
            first = max(0, at - 31)
            h = GEAR[raw[first : at + BLOCK]]
            for step in (1, 2, 4, 8, 16):  # each pass doubles the bytes that a hash covers, to 32
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            h = h[at - first :]
            ends = np.flatnonzero(h >> np.uint32(32 - self.loose_bits) == 0)
            loose.append(ends + at + 1)
            strict.append(ends[h[ends] >> np.uint32(32 - self.strict_bits) == 0] + at + 1)
        return tuple(np.concatenate(x).tolist() if x else [] for x in (strict, loose))

    def ends(self, raw: bytes) -> list[int]:
        strict, loose = self.candidates(np.frombuffer(raw, np.uint8))
        ends, at, n, s, w = [], 0, len(raw), 0, 0
        strict.append(n)
        loose.append(n)
        while at < n:
            s = bisect.bisect_left(strict, at + self.least, s)
            end = strict[s] if s < len(strict) else n
            if end > at + self.normal:
                w = bisect.bisect_left(loose, at + self.normal, w)
                end = min(loose[w] if w < len(loose) else n, at + self.greatest)
            ends.append(min(end, n))
            at = ends[-1]
        return ends

    def digests(self, text: str) -> np.ndarray:
        """The distinct chunks, ascending: 40 bits of the digest, then 8 of the length."""
        raw = text.encode()
        at, found = 0, []
        for end in self.ends(raw):
            found.append(xxhash.xxh3_64_intdigest(raw[at:end]) >> 24 << 8 | end - at)
            at = end
        return np.unique(np.array(found, np.uint64))


def as_text(chunks: np.ndarray) -> str:
    """Twelve hexadecimal digits for each chunk: ten of its digest, two of its length."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's weight in chunks that b has too; of an empty a, 1 if b is empty as well, else 0."""
    if not len(a):
        return float(not len(b))
    lengths = a & np.uint64(255)
    return float(lengths[np.isin(a, b, assume_unique=True)].sum() / lengths.sum())


def fingerprints(docs: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """(doc_id, fingerprint) for each document. Null texts count as empty, with an empty fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [as_text(chunking.digests(text or "")) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, role, doc_id, text): documents in parts by falling id, each part ended by the document after it (role 1).

    The parts are ranges between quantiles of the ids. The last document overall is followed by the first. Documents
    without an id are in parts of their own, with negative numbers. Nothing is collected but the bounds of the parts.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = np.unique(np.array(read.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64)))

    named = read.where("doc_id is not null")
    heads = named.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head"))
    heads = sorted(tuple(row) for row in heads.collect())  # one row for each part
    # the head of a part ends the part above it, and the head of the highest ends the lowest
    follows = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(np.int64))
        return pd.Series([[p, follows[i]] if i in follows else [p] for p, i in zip(own.tolist(), ids.tolist())])

    placed = named.select("doc_id", "text", F.posexplode(parts_of("doc_id")).alias("role", "part"))
    loose = read.where("doc_id is null").withColumns(
        {"role": F.lit(0), "part": (-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int")}
    )
    return placed.unionByName(loose).select("part", "role", "doc_id", "text")


def edited_likeness(docs: DataFrame, chunking: Chunking = Chunking(), parts: int | None = None) -> DataFrame:
    """Each document's fingerprint held against that of an edited text and that of the next document.

    Next is the document with the next smaller id, after the last the one with the
    greatest. The edited text has the last floor(n_chars / 2) characters replaced
    by as many, or all, of the next document's first. Null texts count as empty.
    Rows that share an id follow each other by a hash of their texts. A row without
    an id has no next document: an empty text stands in. One document alone is its
    own next. An empty table gives no rows. Other columns are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EDITED.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        held, out = None, []

        def answer(row: tuple, next_text: str, next_chunks: np.ndarray) -> None:
            _, _, doc_id, text, chunks = row
            half = len(text) // 2
            edited = text[: len(text) - half] + next_text[:half]
            other = chunking.digests(edited) if half else chunks
            out.append(
                (
                    doc_id,
                    len(text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    as_text(chunks),
                    as_text(other),
                    containment(chunks, other),
                    containment(chunks, next_chunks),
                )
            )

        def flush() -> pa.RecordBatch:
            columns = list(map(list, zip(*out))) or [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        nothing = np.empty(0, np.uint64)
        for batch in batches:
            for some in slices(batch):
                for part, role, doc_id, text in zip(*(c.to_pylist() for c in some.columns)):
                    chunks = chunking.digests(text)
                    if held is not None and held[1] == 0:
                        followed = held[0] == part and part >= 0
                        answer(held, text if followed else "", chunks if followed else nothing)
                    held = (part, role, doc_id, text, chunks)
                yield flush()
        if held is not None and held[1] == 0:
            answer(held, "", nothing)
        yield flush()

    ordered = (
        beside_next(docs, parts)
        .repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int"))
        .sortWithinPartitions("part", "role", F.desc("doc_id"), F.xxhash64("text"))
    )
    return ordered.mapInArrow(run, EDITED)
