"""Quality rules from tokeniser fertility: what public vocabularies make of a text.

A text is encoded whole by a piece vocabulary with byte fallback: characters per
token, the share of tokens that stand for single bytes, and the entropy of the token
counts. A byte-level vocabulary of many languages, which has no fallback, gives a second
figure of characters per token. Each is held against a band of the text's language and length
class (the whole part of the binary logarithm of its tokens): the median and half
the distance between the quartiles of that group, from exact counts of figures
rounded to three places. Each distinct text that passes the base rules counts once,
so copies and rows that go anyway don't set the bands. A group's bounds are drawn
towards those of its language, and a language's towards those of all texts, by its
number of texts: n of them weigh n / (n + STRENGTH). So no group is too small to
have a band, and none changes its band at some size. Beside the bands stand plain
base rules: too few words, and too many words in repeated windows.
"""

from __future__ import annotations

import base64
from array import array
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_slices, resident, stored, unused, without

SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = SPACES.encode()

#: Units longer than this aren't kept.
LONGEST_KEPT = 48

FIGURES = ("chars_per_token", "byte_share", "entropy", "chars_per_byte_token")

#: Texts that the wider group's bounds weigh.
STRENGTH = 50

#: Half quartile distances from the median to either bound. Bytes are rare, so their share scatters more.
WIDTHS = {"chars_per_token": 8.0, "byte_share": 20.0, "entropy": 8.0, "chars_per_byte_token": 8.0}

#: The least half quartile distances, near the smallest of any language and length class at sf0.1: a group of texts
#: that are nearly alike doesn't narrow its band beyond them.
LEAST_HALF = {"chars_per_token": 0.015, "byte_share": 0.001, "entropy": 0.035, "chars_per_byte_token": 0.015}


class PieceIds(dict):
    """Maps what stands between two spaces to its piece ids (32-bit numbers); emptied when it holds ``limit``."""

    def __init__(self, model_path: str, limit: int = 500_000):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = limit
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])

    def __missing__(self, unit: str) -> bytes:
        ids = array("i", self.model.encode(unit)).tobytes()
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text. Pieces join across spaces only where two spaces meet or stand at an end."""
        if not text:
            return np.empty(0, np.int32)
        if "  " in text or text[0] == " " or text[-1] == " " or "\u2581" in text:  # the last is the model's own space
            return np.array(self.model.encode(text), np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), np.int32)


def byte_encoder(ranks_path: str) -> Callable[[str], list[int]]:
    """The ids of a text by a byte-level vocabulary, given as a file of ranks; no string of it is special."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def vocabularies(model_path: str, ranks_path: str) -> tuple[PieceIds, Callable[[str], list[int]]]:
    """This Python worker's copies of the two vocabularies."""
    return resident(("fertility", model_path, ranks_path), lambda: (PieceIds(model_path), byte_encoder(ranks_path)))


def fertility(text: str, pieces: PieceIds) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, byte share and entropy in bits (None without tokens)."""
    ids = pieces.ids(text)
    if not len(ids):
        return 0, None, None, None
    counts = np.bincount(ids, minlength=len(pieces.is_byte))
    share = counts[pieces.is_byte].sum() / len(ids)
    counts = counts[counts > 0]
    entropy = np.log2(len(ids)) - float((counts * np.log2(counts)).sum()) / len(ids)
    return len(ids), len(text) / len(ids), float(share), max(0.0, entropy)


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of ``window`` words found twice or more in this text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    factor, span, done, at = 0x9E3779B97F4A7C15, h, None, 0
    for bit in range(window.bit_length()):  # hashes of 1, 2, 4, ... words, put together to a whole window
        if window >> bit & 1:
            part = span[at : at + n] * np.uint64(pow(factor, at, 1 << 64))
            done, at = part if done is None else done + part, at + (1 << bit)
        step = 1 << bit
        if window >> bit > 1:
            span = span[:-step] + span[step:] * np.uint64(pow(factor, step, 1 << 64))
    order = np.argsort(done, kind="stable")
    same = done[order][1:] == done[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(SPACES):
            seen.add(line)
    return repeats


def measures(docs: DataFrame, model_path: str, ranks_path: str, window: int = 8) -> DataFrame:
    """A row for each document with its id, language, base counts, fertility figures and its text's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (pieces, encode), rows = vocabularies(model_path, ranks_path), []
        texts = batch.column(2).to_pylist()
        for text in texts:
            text = text or ""
            raw = text.encode()
            words = raw.split()
            rows.append(
                (
                    len(words),
                    len(text) - (len(raw) - len(raw.translate(None, SPACE_BYTES))),
                    len(raw) - len(raw.translate(None, SYMBOLS)),
                    repeated_lines(text),
                    repeated_words(words, window),
                    *fertility(text, pieces),
                    len(text) / len(encode(text)) if text else None,
                )
            )
        columns = list(map(list, zip(*rows))) if rows else [[] for _ in range(10)]
        kinds = [pa.int64()] * 6 + [pa.float64()] * 4
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(3)],
            ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *FIGURES, "text_hash"],
        )

    return map_slices(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            "text",
            F.xxhash64("text").alias("text_hash"),
        ),
        run,
        "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, chars_per_byte_token double, text_hash long",
    )


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def bands(found: DataFrame, keys: list[str], widths: dict[str, float]) -> DataFrame:
    """Per group: ``texts``, and for each figure the lowest and highest value that pass by this group alone.

    Texts that fail the base rules don't count, and copies of a text count once.
    """
    texts = found.where((F.col("n_tokens") > 0) & ~base_failed()).groupBy(*keys, "text_hash").agg(*(F.max(name).alias(name) for name in FIGURES))
    parts = []
    for name in FIGURES:
        q = F.percentile(F.round(name, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        half = F.greatest((q[2] - q[0]) / 2, F.lit(LEAST_HALF[name])) * widths[name]
        parts += [(q[1] - half).alias(f"low_{name}"), (q[1] + half).alias(f"high_{name}")]
    return texts.groupBy(*keys).agg(F.count("*").alias("texts"), *parts)


BOUNDS = [f"{end}_{name}" for name in FIGURES for end in ("low", "high")]


def _drawn(own: DataFrame, wider: DataFrame, keys: list[str], strength: float) -> DataFrame:
    """The bounds of the groups, drawn towards those of the wider groups that share ``keys`` (NULL is a key like any other)."""
    wider = wider.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in BOUNDS))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = own.join(wider, same) if keys else own.join(F.broadcast(wider), F.lit(True))  # all texts have one row
    weight = F.col("texts") / (F.col("texts") + F.lit(float(strength)))
    drawn = [(weight * F.col(c) + (1 - weight) * F.col(f"_{c}")).alias(c) for c in BOUNDS]
    return both.select(*[c for c in own.columns if c not in BOUNDS], *drawn)


def judge(
    docs: DataFrame, model_path: str, ranks_path: str, widths: dict[str, float] = WIDTHS, strength: float = STRENGTH
) -> DataFrame:
    """The measures of each document with ``base_failed``, the band's verdict and ``kept``.

    Null texts count as empty: no words, so they fail the base rules. A null
    language is a group like any other. A band is ``widths`` half quartile
    distances to either side of the median, drawn towards the wider groups' bounds as
    if these stood for ``strength`` texts; a group without a text that counts has the bounds of
    its language, or of all texts. The byte share has no lower bound. Repeated rows
    are judged alike; an empty table gives no rows. Rows whose figures lie exactly
    on a bound pass.
    """
    found = stored(
        measures(docs, model_path, ranks_path).withColumn(
            "length_class", F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens"))).cast("int")
        )
    )
    overall = bands(found, [], widths)
    coarse = _drawn(bands(found, ["lang"], widths), overall, [], strength)
    fine = _drawn(bands(found, ["lang", "length_class"], widths), coarse, ["lang"], strength)

    def beside(left: DataFrame, right: DataFrame, name: str, *keys: str) -> DataFrame:
        right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*BOUNDS).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = left.join(right, same, "left") if keys else left.join(F.broadcast(right), F.lit(True), "left")
        return joined.drop(*(f"_{k}" for k in keys))

    judged = beside(beside(found, fine, "fine", "lang", "length_class"), coarse, "coarse", "lang")
    judged = beside(judged, overall, "overall")
    band = F.coalesce("fine", "coarse", "overall")
    ok = F.lit(True)
    for name in FIGURES:
        low = F.lit(0.0) if name == "byte_share" else band[f"low_{name}"]
        ok = ok & F.col(name).between(low, band[f"high_{name}"])
    return (
        judged.withColumn("base_failed", base_failed())
        .withColumn("in_band", F.coalesce(ok, F.lit(True)))
        .withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
        .drop("fine", "coarse", "overall", "text_hash")
    )


def keep_good(docs: DataFrame, model_path: str, ranks_path: str) -> DataFrame:
    """The documents that pass, with all their columns.

    Rows are told apart by a hash of id, language and text, so rows that share an id, or have none, are judged each
    by its own.
    """
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "lang", "text"))
    judged = judge(keyed.select(F.col(row).alias("doc_id"), "lang", "text"), model_path, ranks_path)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return without(keyed, gone, row).select(*docs.columns)
