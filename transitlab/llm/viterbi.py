"""SentencePiece encoding and decoding by a Viterbi search in batches of numpy arrays.

A text with spaces as the meta space (and one before it) falls into words, each
with the spaces before it; no piece of the vocabulary reaches across their bounds.
Words of equal length advance together, one character at a time: hashes of all
substrings that end there probe the sorted keys of the pieces of that length, and
the maxima over all words at once store how far back the best last piece begins.
A character without a piece costs as much as its UTF-8 bytes, which have pieces of
their own, so every text comes back exactly.

The public vocabulary is a BPE vocabulary: its scores are ranks and not
log-probabilities. By Zipf's law the piece of rank r gets -log(r + shift), so that
the best path has few, frequent pieces. It need not be the path of BPE's merges.
A literal meta space in a text is written as bytes, to be told from a space.
"""

from __future__ import annotations

import re
from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, resident

META = 0x2581
LITERAL = 0x110000  # above all characters: the code of a literal meta space
FACTOR = 0x9E3779B97F4A7C15
SEGMENT = re.compile(r" *[^ ]+| +")

#: Words longer than this are searched alone, with all their positions probed at once.
LONGEST_TOGETHER = 48

#: Words of one length that advance together at most.
TOGETHER = 1 << 16


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each character code."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... characters of each row."""
    n, length = codes.shape
    out, mixed = np.zeros((length + 1, n), np.uint64), _mixed(codes)
    for j in range(length):
        out[j + 1] = out[j] * np.uint64(FACTOR) + mixed[:, j]
    return out


class Pieces:
    """A vocabulary: sorted keys, scores and ids of its pieces by length; what each id stands for."""

    def __init__(self, model_path: str, shift: float = 10.0, limit: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [0] * 256
        self.bytes_of = [b""] * size
        by_length: dict[int, list[tuple[int, int]]] = {}
        first = 0
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], self.bytes_of[i], first = i, bytes([value]), i + 1
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = name.replace(chr(META), " ").encode()
                key = int(_prefixes(np.array([[ord(c) for c in name]], np.uint32))[-1, 0])
                by_length.setdefault(len(name), []).append((key, i))
        self.score_of = -np.log(np.maximum(0, np.arange(size) - first) + shift)
        self.byte_score = -float(np.log(size + shift)) - 1.0
        self.longest = max(by_length)
        self.keys, self.ids = {}, {}
        for length, found in by_length.items():
            found.sort()
            self.keys[length] = np.array([k for k, _ in found], np.uint64)
            self.ids[length] = np.array([i for _, i in found], np.int32)
        self.factor = [np.uint64(pow(FACTOR, n, 1 << 64)) for n in range(self.longest + 1)]
        self.plain, self.spaced, self.limit = {}, {}, limit

    def probe(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces with these hashes (-1 if none) and their scores."""
        keys = self.keys[length]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        ids = np.where(keys[at] == hashes, self.ids[length][at], -1)
        return ids, np.where(ids >= 0, self.score_of[ids], -np.inf)

    def single(self, codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of single characters; those without a piece have id -1 and the score of their bytes."""
        ids, scores = self.probe(hashes, 1)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        width = np.where(codes == LITERAL, 3, width)
        return ids, np.where(ids >= 0, scores, self.byte_score * width)

    def together(self, words: list[str], codes: np.ndarray) -> list[bytes]:
        """The ids of words of one length, as little-endian 32-bit numbers. Ties go to the shorter last piece."""
        n, length = codes.shape
        prefix = _prefixes(codes)
        best = np.zeros((length + 1, n))
        back = np.ones((length + 1, n), np.int8)
        piece = np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                if size not in self.keys:
                    continue
                hashes = prefix[end] - prefix[end - size] * self.factor[size]
                if size == 1:
                    piece[end], scores = self.single(codes[:, end - 1], hashes)
                    best[end] = best[end - 1] + scores
                    continue
                ids, scores = self.probe(hashes, size)
                scores = scores + best[end - size]
                better = scores > best[end]
                best[end][better], back[end][better], piece[end][better] = scores[better], size, ids[better]
        return [self.walk(word, back[:, i].tolist(), piece[:, i].tolist()) for i, word in enumerate(words)]

    def alone(self, word: str, codes: np.ndarray) -> bytes:
        """The ids of a long word: all substrings probed at once, then one walk over the positions."""
        n = codes.shape[1]
        prefix = _prefixes_long(codes[0])
        ids, scores = [None], [None]
        for size in range(1, self.longest + 1):
            if size not in self.keys or size > n:
                ids.append([-1] * (n + 1))
                scores.append([-np.inf] * (n + 1))
                continue
            hashes = prefix[size:] - prefix[: n + 1 - size] * self.factor[size]
            i, s = self.single(codes[0], hashes) if size == 1 else self.probe(hashes, size)
            ids.append([-1] * size + i.tolist())
            scores.append([-np.inf] * size + s.tolist())
        best, back, piece = [0.0], [1], [-1]
        for end in range(1, n + 1):
            top, size_of = best[end - 1] + scores[1][end], 1
            for size in range(2, min(end, self.longest) + 1):
                if (score := best[end - size] + scores[size][end]) > top:
                    top, size_of = score, size
            best.append(top)
            back.append(size_of)
            piece.append(ids[size_of][end])
        return self.walk(word, back, piece)

    def walk(self, word: str, back: list[int], piece: list[int]) -> bytes:
        """Follow the backpointers from the end of the word."""
        found, end = [], len(word)
        while end:
            if piece[end] >= 0:
                found.append(piece[end])
            else:
                found += [self.byte_ids[b] for b in reversed(word[end - 1].encode())]
            end -= back[end]
        return np.array(found[::-1], "<i4").tobytes()

    def learn(self, words: Iterable[str], lead: str, into: dict[str, bytes]) -> None:
        """The ids of all these words (with ``lead`` before each), put into ``into``."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for own in by_length.values():
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                full = [lead + word for word in some]
                codes = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32).reshape(len(full), -1)
                codes = np.where(codes == META, LITERAL, np.where(codes == 32, META, codes)).astype(np.uint32)
                if codes.shape[1] <= LONGEST_TOGETHER:
                    into.update(zip(some, self.together(full, codes)))
                else:
                    into.update((w, self.alone(f, c[None])) for w, f, c in zip(some, full, codes))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; none for a null or empty text."""
        if len(self.plain) + len(self.spaced) > self.limit:
            self.plain, self.spaced = {}, {}
        cut: list[tuple[dict, list[str]]] = []
        for text in texts:
            text = text or ""
            simple = bool(text) and "  " not in text and text[0] != " " and text[-1] != " "
            cut.append((self.spaced, text.split(" ")) if simple else (self.plain, SEGMENT.findall(" " + text) if text else []))
        for lead, known in ((" ", self.spaced), ("", self.plain)):
            new = {word for into, words in cut if into is known for word in words if word not in known}
            self.learn(new, lead, known)
        out = [b"".join(map(into.__getitem__, words)) for into, words in cut]
        for known in (self.spaced, self.plain):  # long words aren't kept
            for word in [w for into, words in cut if into is known for w in words if len(w) > LONGEST_TOGETHER]:
                known.pop(word, None)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of these ids; bytes that are no UTF-8 (not from ``encode``) become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")[1:]


def _prefixes_long(codes: np.ndarray) -> np.ndarray:
    """As ``_prefixes`` for one long word: sums of c[i] * F ** -i, brought to the same scale by F ** j."""
    n = len(codes)
    inverse = pow(FACTOR, -1, 1 << 64)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = np.uint64(FACTOR)
    powers = np.multiply.accumulate(powers)
    inverses = np.full(n, np.uint64(inverse))
    inverses = np.multiply.accumulate(inverses) if n else inverses
    return np.r_[np.zeros(1, np.uint64), np.add.accumulate(_mixed(codes) * inverses)] * powers


def pieces(model_path: str) -> Pieces:
    """This Python worker's copy of the vocabulary."""
    return resident(("viterbi", model_path), lambda: Pieces(model_path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids, exact) for each document; ``exact``: the decoded ids are the text again.

    A null text counts as empty: no ids. Repeated rows and null ids are answered
    each; an empty table gives no rows. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary, texts = pieces(model_path), [text or "" for text in batch.column(1).to_pylist()]
        found = [np.frombuffer(raw, "<i4") for raw in vocabulary.encode(texts)]
        offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else [], pa.int32())),
                pa.array([vocabulary.decode(ids.tolist()) == text for ids, text in zip(found, texts)], pa.bool_()),
            ],
            ["doc_id", "n_chars", "n_ids", "ids", "exact"],
        )

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_chars long, n_ids long, ids array<int>, exact boolean",
    )


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from ``doc_id`` and ``ids``; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        vocabulary = pieces(model_path)
        for batch in batches:
            texts = [vocabulary.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
