"""Substring dedup: repeated-phrase automata over shards of source documents.

A window of ``window`` words (50) goes where the same words also start in a
document with a smaller id. The steps:

1. Phrases. Every window names the phrase in it (8 words) with the least hash, so
   equal windows name equal phrases at equal places, and few phrases are named
   (about two in 44 words). A phrase that documents of different ids name is a
   recurring one; its source is the document with the least id. Only these groups
   of hashes, pre-aggregated, meet in a shuffle.
2. Shards. A shard is a source document: the stretches of its text around its
   recurring phrases, and the stretches of all other documents around the same
   phrases (every window that names such a phrase lies whole in its stretch). A
   source whose phrases occur very often is split by a hash of the other
   document, each part with its own copy of the source's stretches.
3. Automata. Each shard compiles its phrases with pyahocorasick and streams the
   stretches of the other documents, by rising id, to locate every occurrence.
   A window that holds an occurrence is compared with the windows of the source
   and of the documents before it: equal hashes, confirmed word by word.
4. In a split shard, documents before this one may be in another part: windows
   that are not found there are grouped by their words' digest across all parts,
   pre-aggregated to the least id.
5. Removal. The spans found are joined to the documents by id, and the words they
   cover go.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from typing import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices, stored, unused

PHRASE = 8
FACTOR = 0x9E3779B97F4A7C15
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int, factor: int = FACTOR) -> np.ndarray:
    """A hash of each run of ``size`` items, put together from runs of 1, 2, 4, ... items."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    span, done, at = hashes, np.zeros(n, np.uint64), 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            done = done + span[at : at + n] * np.uint64(pow(factor, at, 1 << 64))
            at += 1 << bit
        if size >> bit > 1:
            step = 1 << bit
            span = span[:-step] + span[step:] * np.uint64(pow(factor, step, 1 << 64))
    done = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # so that order says nothing of the words
    return done ^ (done >> np.uint64(32))


def running(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least (else the greatest) of each run of ``size`` values."""
    pick = np.minimum if least else np.maximum
    span, width = values, 1
    while 2 * width <= size:
        span, width = pick(span[:-width], span[width:]), 2 * width
    rest = size - width
    return pick(span[: len(span) - rest], span[rest:]) if rest else span


def named_phrases(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases that have the least hash in some window (ties: all of them)."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    phrases = run_hashes(word_hashes(words), PHRASE)
    reach = window - PHRASE + 1  # phrases in a window
    least = running(phrases, reach, True)
    edge = np.zeros(reach - 1, np.uint64)
    named = running(np.concatenate([edge, least, edge]), reach, False)
    # a phrase is named if its hash is the least of a window that holds it: the greatest least is then its own
    at = np.flatnonzero(named == phrases)
    return at, phrases[at]


def phrases(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, at, phrase): each phrase that a document names. ``key`` tells rows that share an id apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, places, hashes = [], [], [], []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            at, phrase = named_phrases(text.encode().split(), window)
            ids.append(np.full(len(at), doc_id, np.int64))
            keys.append(np.full(len(at), key, np.int64))
            places.append(at)
            hashes.append(phrase.view(np.int64))
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, keys, places, hashes)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "key", "at", "phrase"]
        )

    return map_slices(docs.select("doc_id", "key", "text"), run, "doc_id long, key long, at long, phrase long")


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of the runs [start, start + length) as separate spans; ``starts`` ascend."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length
    return list(zip(first.tolist(), last.tolist()))


STRETCH = (
    "source long, part long, parts long, role int, doc_id long, key long, first long, words string, places array<int>"
)


def stretches(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """What each document sends to the shards of its recurring phrases' sources."""
    out: dict[str, list] = {x.split()[0]: [] for x in STRETCH.split(", ")}
    for doc_id, key, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
        words = text.encode().split()
        hits.sort(key=lambda hit: (hit["source"], hit["at"]))
        for source, own in groupby(hits, key=lambda hit: hit["source"]):
            own = list(own)
            at, parts = np.array([hit["at"] for hit in own]), own[0]["parts"]
            reach = window - PHRASE
            for first, last in spans(at, reach + window):  # before the phrase, and to the end of its last window
                first, last = max(0, first - reach), min(len(words), last - reach)
                inside = at[(at >= first) & (at + PHRASE <= last)] - first
                is_source = source == doc_id
                for part in range(parts) if is_source else [xxhash.xxh3_64_intdigest(str(doc_id)) % parts]:
                    values = (
                        source, part, parts, int(not is_source), doc_id, key, first,
                        b" ".join(words[first:last]).decode(), inside.tolist() if is_source else [],
                    )
                    for name, value in zip(out, values):
                        out[name].append(value)
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))


class Shard:
    """A source's automaton and the windows known so far, each with a place where it stands."""

    def __init__(self, window: int):
        self.window = window
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.texts: list[list[bytes]] = []
        self.known = [np.empty(0, np.uint64)] * 3  # hashes in order, the text and the place of each
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compiled = False

    def learn(self, words: list[bytes], hashes: np.ndarray, at: np.ndarray) -> None:
        """Windows that later documents are held against."""
        self.texts.append(words)
        self.fresh.append((hashes[at], np.full(len(at), len(self.texts) - 1), at))

    def add_source(self, text: str, places: list[int]) -> None:
        words = text.encode().split()
        for at in places:
            self.automaton.add_word(f" {b' '.join(words[at : at + PHRASE]).decode()} ")
        hashes = run_hashes(word_hashes(words), self.window)
        self.learn(words, hashes, np.arange(len(hashes)))

    def settle(self) -> None:
        """Put what was learnt in order; called as a new document begins."""
        if self.fresh:
            parts = [np.concatenate(x) for x in zip(self.known, *self.fresh)]
            _, first = np.unique(parts[0], return_index=True)
            self.known, self.fresh = [x[first] for x in parts], []

    def located(self, text: str, n_words: int) -> np.ndarray:
        """Starts of the windows that hold a phrase of the source."""
        if not self.compiled:
            self.automaton.make_automaton()
            self.compiled = True
        marked = np.zeros(n_words + 1, np.int64)
        hay = f" {text} "
        gaps = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le"), np.uint32) == 32)
        ends = np.fromiter((end for end, _ in self.automaton.iter(hay)), np.int64)
        at = np.searchsorted(gaps, ends) - PHRASE
        np.add.at(marked, np.maximum(0, at + PHRASE - self.window), 1)
        np.add.at(marked, at + 1, -1)
        return np.flatnonzero(np.cumsum(marked)[: max(0, n_words - self.window + 1)] > 0)

    def confirmed(self, words: list[bytes], hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the windows at ``at`` stand in a text known so far."""
        known, texts, places = self.known
        if not len(known) or not len(at):
            return np.zeros(len(at), bool)
        slot = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        found = known[slot] == hashes[at]
        hit = np.flatnonzero(found)
        text, place = texts[slot[hit]].astype(np.int64), places[slot[hit]].astype(np.int64)
        # windows that follow each other in both texts are compared as one run of words
        new = np.r_[True, (np.diff(at[hit]) != 1) | (np.diff(text) != 0) | (np.diff(place) != 1)] if len(hit) else []
        for run in np.split(np.arange(len(hit)), np.flatnonzero(new)[1:]) if len(hit) else []:
            length = len(run) - 1 + self.window
            a, b = int(at[hit[run[0]]]), int(place[run[0]])
            if words[a : a + length] != self.texts[text[run[0]]][b : b + length]:
                found[hit[run]] = False
        return found


FOUND = "doc_id long, key long, first long, last long, digest binary"


def search_shards(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove (no digest), and in split shards the windows not found there (with digest).

    Rows come sorted by source, part, role, doc_id: a source's own stretches first, then documents by rising id.
    """
    shard, at, doc = None, None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(map(list, zip(*out))) or [[]] * 5
        out.clear()
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "key", "first", "last", "digest"]
        )

    for batch in batches:
        for part_of in slices(batch, "words"):
            for source, part, parts, role, doc_id, key, first, text, places in zip(
                *(c.to_pylist() for c in part_of.columns)
            ):
                if (source, part) != at:
                    shard, at, doc = Shard(window), (source, part), None
                if role == 0:
                    shard.add_source(text, places)
                    continue
                if doc_id != doc:  # rows that share an id don't count as earlier
                    shard.settle()
                    doc = doc_id
                words = text.encode().split()
                hashes = run_hashes(word_hashes(words), window)
                starts = shard.located(text, len(words))
                found = shard.confirmed(words, hashes, starts)
                out += [(doc_id, key, first + a, first + b, None) for a, b in spans(starts[found], window)]
                rest = starts[~found]
                if parts == 1:
                    shard.learn(words, hashes, rest)
                else:
                    out += [
                        (doc_id, key, first + a, first + a + window, hashlib.blake2b(b" ".join(words[a : a + window]), digest_size=16).digest())
                        for a in rest.tolist()
                    ]
            yield flush()
    yield flush()


def removed_spans(docs: DataFrame, window: int, part_phrases: int) -> DataFrame:
    """(doc_id, key, spans): the word spans to remove, for the documents that have any. ``docs``: doc_id, key, text."""
    named = stored(phrases(docs.where("doc_id is not null and text is not null"), window))
    recurring = (
        named.groupBy("phrase")
        .agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
        .where("source < last")
        .drop("last")
    )
    # times are counted before shards are split, so a part has about as many phrases as any other
    weight = recurring.groupBy("source").agg(F.ceil(F.sum("times") / part_phrases).alias("parts"))
    marked = recurring.join(weight, "source").select("phrase", "source", "parts")
    hits = (
        named.join(marked, "phrase")
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("source", "at", "parts")).alias("hits"))
    )
    sent = map_slices(docs.join(hits, ["doc_id", "key"]).select("doc_id", "key", "text", "hits"), lambda b: stretches(b, window), STRETCH)
    found = stored(
        sent.repartition("source", "part")
        .sortWithinPartitions("source", "part", "role", "doc_id", "key", "first")
        .mapInArrow(lambda batches: search_shards(batches, window), FOUND)
    )
    open_windows = found.where("digest is not null")
    earliest = open_windows.groupBy("digest").agg(F.min("doc_id").alias("earliest"))
    late = open_windows.join(earliest, "digest").where("earliest < doc_id").select("doc_id", "key", "first", "last")
    return (
        found.where("digest is null")
        .select("doc_id", "key", "first", "last")
        .union(late)
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )


NEW = ("n_words", "n_removed", "kept_text")


def remove_repeats(docs: DataFrame, window: int = 50, part_phrases: int = 2_000) -> DataFrame:
    """All columns of ``docs``, then ``n_words``, ``n_removed`` and ``kept_text``: the kept words joined by one space.

    Words are runs of anything but space and the bytes 9 to 13. A null text has
    none. A document with a null id keeps all its words and counts for no other.
    Rows that share an id are not earlier than one another. Of equal windows in one
    document all stay if no smaller id has them. Columns named like the three new
    ones are replaced. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in NEW]
    keyed = docs.select(*columns)
    key, cover, own = (unused(keyed, name) for name in ("key", "cover", "own"))
    keyed = keyed.withColumn(key, F.xxhash64("text"))
    plain = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")
    gone = removed_spans(plain, window, part_phrases).toDF(own, key, cover)
    joined = keyed.withColumn(own, F.col("doc_id").cast("long")).join(gone, [own, key], "left").select(*columns, cover)
    text_at = columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, removed, kept = [], [], []
                for text, spans_of in zip(part.column(text_at).to_pylist(), part.column(len(columns)).to_pylist()):
                    words = text.encode().split() if text else []
                    stay = words
                    if spans_of:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for span in spans_of:
                            edges[span["first"]] += 1
                            edges[span["last"]] -= 1
                        stay = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]
                    counts.append(len(words))
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay).decode())
                new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*columns, *NEW])

    schema = keyed.select(*columns).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(run, schema)


def with_repeats_removed(docs: DataFrame, window: int = 50) -> DataFrame:
    """The columns of ``docs``; where words went, the text is what was kept and ``n_chars`` (if there) its length.

    A text that loses all its words stays as an empty text. Other texts stay as they are, white space included.
    """
    clash = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in NEW}
    found = remove_repeats(docs.withColumnsRenamed(clash), window)
    changed = F.col("n_removed") > 0
    if "n_chars" in found.columns:
        length = F.length("kept_text").cast(found.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    found = found.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).drop(*NEW)
    return found.withColumnsRenamed({new: old for old, new in clash.items()}).select(*docs.columns)
