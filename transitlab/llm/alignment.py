"""Cross-tokenizer alignment: which tokens of two vocabularies end together, with corpus-wide counts of such pairs.

1. Tasks encode texts with both vocabularies. A text is cut before a space that
   follows another character than white space, where neither vocabulary joins what
   stands on both sides; what lies between two cuts repeats a great deal, so its
   groups and links are kept.
2. External spill. A task holds the links of the documents that it has met as
   (pair, document) records. When they fill its memory they are sorted and
   radix-partitioned by the B id into compressed runs, side-major: by B id, then A
   id. A run is a head (its pairs with their sums) and a body (their documents).
   Documents and runs are written once to the shared folder.
3. Counts. All heads of a radix partition come together (a pair of any frequency is
   one entry of a head) and a k-way heap merge adds them up, in passes of at most
   ``FAN`` runs. In side-major order a B id's pairs follow one another, so its
   greatest count is known as the merge goes past. Each head is then answered with
   the counts of its pairs, in its own order.
4. Contributions. The answers meet the bodies of their spill again, which is of
   bounded size, and each document adds up what its links contribute.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
from itertools import chain, groupby
from operator import itemgetter
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, slices, tabled
from .tokens import CUT, GLUED, byte_alphabet

#: Links that a task holds before it spills, and documents (as many as their part of a sort key can tell apart).
SPILL_LINKS, DOC_BITS = 4_000_000, 20
#: Runs that are merged at a time.
FAN = 64
#: Units longer than this aren't kept.
LONGEST_KEPT = 48
SPACE = "▁"


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, each as narrow as its greatest value allows, compressed."""
    parts = []
    for column in columns:
        narrow = column.astype(np.min_scalar_type(int(column.max()) if len(column) else 0))
        parts += [struct.pack("<BQ", narrow.itemsize, len(narrow)), narrow.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(packed: bytes) -> list[np.ndarray]:
    data, at, columns = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(data):
        width, n = struct.unpack_from("<BQ", data, at)
        columns.append(np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return columns


class Vocabularies:
    """Both vocabularies: ids of units, the bytes of each token, and how a unit's tokens align."""

    def __init__(self, path_a: str, path_b: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.limit, self.kept = limit, {}
        plain = {chr(stand_in): byte for byte, stand_in in byte_alphabet().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(plain[c] for c in piece) if all(c in plain for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.lone_space = [self.b.piece_to_id(SPACE)]
        #: Pieces never go on past a space after another character, so a text may be cut there.
        self.separable = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        # the text of each token within its group, and at the end of it
        self.written = [f"{i}{end}" for own, end in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(own)) for end in (",", end)]

    def units(self, text: str) -> list[str]:
        """Space and text, cut where both vocabularies may be; each unit begins with a space."""
        if not self.separable:
            return [" " + text]
        if GLUED.search(" " + text):
            return CUT.split(" " + text)
        return [" " + unit for unit in text.split(" ")]

    def spelled(self, units: list[bytes], ids: list[list[int]], entries: list[bytes]) -> list[bool]:
        """Which units are just the bytes of their tokens."""
        return [b"".join(map(entries.__getitem__, own)) == unit for unit, own in zip(units, ids)]

    def align(self, units: list[str]) -> list[tuple | None]:
        """For each unit: A tokens, B tokens, groups, their text, and links (B id, A id). None: bytes differ."""
        all_a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        all_b = [ids or self.lone_space for ids in self.b.encode([unit[1:] for unit in units], num_threads=1)]
        raw = [unit.encode() for unit in units]
        good = [a and b for a, b in zip(self.spelled(raw, all_a, self.bytes_a), self.spelled(raw, all_b, self.bytes_b))]
        found = iter(self.groups([x for x, ok in zip(all_a, good) if ok], [x for x, ok in zip(all_b, good) if ok]))
        return [next(found) if ok else None for ok in good]

    def groups(self, all_a: list[list[int]], all_b: list[list[int]]) -> list[tuple]:
        """All units at a time: they follow one another as one text, and each unit's end is the end of a group."""
        if not all_a:
            return []
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (all_a, all_b))
        n_a, n_b = ([*map(len, ids)] for ids in (all_a, all_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = b[last_b] << 32 | a[last_a]
        bounds = np.searchsorted(last_a, np.cumsum(n_a) - 1) + 1  # groups up to the end of each unit
        # the tokens of A and then of B, group by group: where each stands, and its text
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = 2 * a + (last_a[group_a] == np.arange(len(a)))
        order[np.arange(len(b)) + last_a[group_b] + 1] = 2 * (len(self.bytes_a) + b) + (last_b[group_b] == np.arange(len(b)))
        texts = list(map(self.written.__getitem__, order.tolist()))
        out, packed, group, at = [], links.tobytes(), 0, 0
        for one, other, bound in zip(n_a, n_b, bounds.tolist()):
            last = at + one + other
            out.append((one, other, bound - group, "".join(texts[at:last]), packed[8 * group : 8 * bound]))
            group, at = bound, last
        return out

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """The aligned units of each text; None where it has no tokens."""
        cut = [self.units(text) if text else [] for text in texts]
        if len(self.kept) > self.limit:
            self.kept.clear()
        new = [*set(chain.from_iterable(cut)).difference(self.kept)]
        self.kept.update(zip(new, self.align(new)))
        for units in cut:
            found = [*map(self.kept.__getitem__, units)]
            yield found if found and None not in found else None
        for unit in new:
            if len(unit) > LONGEST_KEPT:
                del self.kept[unit]


def vocabularies(path_a: str, path_b: str, limit: int = 500_000) -> Vocabularies:
    """This Python worker's copy of the two."""
    return resident(("both", path_a, path_b), lambda: Vocabularies(path_a, path_b, limit))


class Radix:
    """Pairs as single numbers in side-major order within their radix partition (the B id's lowest digit)."""

    def __init__(self, partitions: int, size_a: int, size_b: int):
        self.partitions, self.size_a = partitions, size_a
        self.width = -(-size_b // partitions)  # B ids in a partition

    def codes(self, links: np.ndarray) -> np.ndarray:
        a, b = links & 0xFFFFFFFF, links >> 32
        return ((b % self.partitions) * self.width + b // self.partitions) * self.size_a + a

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Where each partition begins in ascending codes, and the end."""
        return np.searchsorted(codes, np.arange(self.partitions + 1) * (self.width * self.size_a))


WRITTEN = (
    "spill long, kind int, part int, at long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string,"
    " head binary, body binary"
)
DOC, RUN = 0, 1


class Spills:
    """One task's documents and links, written out as a spill when they fill its memory."""

    def __init__(self, first: int, radix: Radix, limit: int):
        self.number, self.radix, self.limit = first, radix, limit
        self.docs: list[tuple] = []
        self.links: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, found: list[tuple] | None) -> None:
        n_a, n_b, n_groups, texts, links = zip(*found) if found else ((), (), (), (), ())
        sha = hashlib.sha256("".join(texts)[:-1].encode()).hexdigest() if found else ""
        self.docs.append((doc_id, sum(n_a), sum(n_b), sum(n_groups), sha))
        self.links.append(b"".join(links))
        self.held += len(self.links[-1]) // 8

    def full(self) -> bool:
        return self.held >= self.limit or len(self.docs) >= 1 << DOC_BITS - 1

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        lengths = [len(x) // 8 for x in self.links]
        codes = self.radix.codes(np.frombuffer(b"".join(self.links), np.int64))
        records = codes << DOC_BITS | np.repeat(np.arange(len(lengths)), lengths)
        records.sort()
        records, times = np.unique(records, return_counts=True)
        codes, first = np.unique(records >> DOC_BITS, return_index=True)
        docs, sums = records & (1 << DOC_BITS) - 1, np.add.reduceat(times, first) if len(first) else times
        bounds, edges = np.r_[first, len(records)], self.radix.edges(codes)
        for part, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                own = slice(bounds[low], bounds[high])
                head = squeeze(np.diff(codes[low:high], prepend=0), sums[low:high])
                yield part, head, squeeze(np.diff(bounds[low : high + 1]), docs[own], times[own])

    def write(self) -> pa.RecordBatch:
        n, rows = len(self.docs), list(self.runs())
        pad = [None] * len(rows)
        doc_id, n_a, n_b, n_groups, sha = map(list, zip(*self.docs)) if n else ([], [], [], [], [])
        part, heads, bodies = map(list, zip(*rows)) if rows else ([], [], [])
        columns = [
            pa.array([self.number] * (n + len(rows)), pa.int64()),
            pa.array([DOC] * n + [RUN] * len(rows), pa.int32()),
            pa.array([0] * n + part, pa.int32()),
            pa.array([*range(n), *[n] * len(rows)], pa.int64()),
            *(pa.array(x + pad, pa.int64()) for x in (doc_id, n_a, n_b, n_groups)),
            pa.array(sha + pad, pa.string()),
            *(pa.array([None] * n + x, pa.binary()) for x in (heads, bodies)),
        ]
        self.docs, self.links, self.held, self.number = [], [], 0, self.number + 1
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WRITTEN.split(", ")])


def spilled(docs: DataFrame, path_a: str, path_b: str, partitions: int, limit: int) -> DataFrame:
    """Documents and runs of all tasks. ``docs``: doc_id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        radix = Radix(partitions, len(both.bytes_a), len(both.bytes_b))
        spills = Spills(TaskContext.get().partitionId() << 32, radix, limit)
        for batch in batches:
            for part in slices(batch):
                ids, texts = (column.to_pylist() for column in part.columns)
                for doc_id, found in zip(ids, both.texts(texts)):
                    spills.add(doc_id, found)
                    if spills.full():
                        yield spills.write()
        yield spills.write()

    return docs.mapInArrow(run, WRITTEN)


Run = tuple[np.ndarray, np.ndarray]


def merge(runs: list[Run], size_a: int) -> Iterator[Run]:
    """A k-way heap merge: the pairs of one B id after the other, each with the sum of its counts in all runs."""

    def steps(codes: np.ndarray, sums: np.ndarray, place: int):
        side = codes // size_a
        cuts = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(codes)]
        for low, high in zip(cuts, cuts[1:]):
            yield int(side[low]), place, codes[low:high], sums[low:high]

    heap = heapq.merge(*(steps(*run, place) for place, run in enumerate(runs)), key=itemgetter(0))
    for _, same in groupby(heap, key=itemgetter(0)):
        own = list(same)
        if len(own) == 1:
            yield own[0][2], own[0][3]
            continue
        codes, place = np.unique(np.concatenate([x[2] for x in own]), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, place, np.concatenate([x[3] for x in own]))
        yield codes, total


def counted(heads: list[bytes], size_a: int, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the heads in order, their counts, and whether a pair's count is its B id's greatest."""
    while len(heads) > fan:  # a pass: sets of runs become runs
        merged = []
        for first in range(0, len(heads), fan):
            runs = list(merge([opened(head) for head in heads[first : first + fan]], size_a))
            codes, sums = (np.concatenate(x) for x in zip(*runs))
            merged.append(squeeze(np.diff(codes, prepend=0), sums))
        heads = merged
    steps = [(codes, sums, sums == sums.max()) for codes, sums in merge([opened(head) for head in heads], size_a)]
    return tuple(np.concatenate(x) for x in zip(*steps))


def opened(head: bytes) -> Run:
    steps, sums = expand(head)
    return np.cumsum(steps), sums


def answers(heads: DataFrame, path_a: str, path_b: str, fan: int) -> DataFrame:
    """(spill, part, answer): for each head the counts of its pairs and whether they are their B id's greatest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a = len(vocabularies(path_a, path_b).bytes_a)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for part, group in groupby(rows, key=itemgetter(0)):
            spills, heads = zip(*(row[1:] for row in group))
            codes, counts, best = counted(list(heads), size_a, fan)
            for first in range(0, len(heads), fan):
                out = []
                for head in heads[first : first + fan]:
                    at = np.searchsorted(codes, opened(head)[0])
                    out.append(squeeze(counts[at], best[at].view(np.uint8)))
                own = spills[first : first + fan]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([part] * len(own), pa.int32()), pa.array(out, pa.binary())],
                    ["spill", "part", "answer"],
                )

    dealt = heads.select("part", "spill", "head").repartition("part").sortWithinPartitions("part", "spill")
    return dealt.mapInArrow(run, "spill long, part int, answer binary")


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def contributions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a spill in order: for each part its answer and its body, and at last the documents."""
    spill, best_of, sum_of, waiting = None, None, None, None
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        spills, kinds = columns["spill"].to_numpy(), columns["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(spills) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(spills)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if spills[low] != spill:
                spill, best_of, sum_of = spills[low], None, None
            if kinds[low] == RUN:
                for i in range(low, high):
                    if (answer := columns["answer"][i].as_py()) is not None:
                        waiting = expand(answer)
                        continue
                    if best_of is None:
                        best_of, sum_of = np.zeros((2, columns["at"][i].as_py()), np.int64)
                    sizes, docs, times = expand(columns["body"][i].as_py())
                    counts, best = (np.repeat(x, sizes) for x in waiting)
                    np.add.at(sum_of, docs, times * counts)
                    np.add.at(best_of, docs, times * best)
            else:
                own = {name: column.slice(low, high - low) for name, column in columns.items()}
                at = own["at"].to_numpy()
                sums = [np.zeros(len(at), np.int64)] * 2 if best_of is None else [best_of[at], sum_of[at]]
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], own["n_groups"], *map(pa.array, sums), own["groups_sha256"]],
                    [x.split()[0] for x in RESULT.split(", ")],
                )


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    spill_links: int = SPILL_LINKS,
    fan: int = FAN,
    partitions: int | None = None,
) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level BPE vocabulary, which encodes space and text;
    ``path_b`` a piece vocabulary with byte fallback, which encodes the text and adds
    the space. Strings of special tokens in a text are plain text. Where tokens of
    both end at the same byte they are a link and end a group; no token is empty, so
    there are as many links as groups. A pair's count is the number of its links in
    all documents. ``n_best`` counts the links whose pair has the greatest count of
    its B id, ties included; ``count_sum`` adds the counts of all links. A null or
    empty text, and one whose tokens don't spell it in both vocabularies, has zeros
    and an empty digest, and adds no links. Rows that repeat an id or a text are
    documents of their own; a null id stays null. Other columns are not read. An
    empty table gives no rows.
    """
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    if not partitions:
        partitions = min(1_024, max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    written = tabled(spilled(plain, path_a, path_b, partitions, spill_links))
    runs = written.where(F.col("kind") == RUN)
    answered = answers(runs, path_a, path_b, fan).withColumn("kind", F.lit(RUN))
    names = "spill kind part at doc_id n_a n_b n_groups groups_sha256 body".split()
    # the runs of a spill come before its documents, and the answer of a part before its body
    rows = written.select(*names).unionByName(answered, allowMissingColumns=True)
    dealt = rows.repartition("spill").sortWithinPartitions("spill", F.desc("kind"), "part", F.isnull("answer"), "at")
    return dealt.mapInArrow(contributions, RESULT)
