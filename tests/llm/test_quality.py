import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from transitlab.llm import quality
from transitlab.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeated = len(words), len(covered)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, n < 20 or 100 * repeated > 30 * n,
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_of_the_query(spark, small, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op8_tokeniser_fertility"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == slow_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.in_band)


def slow_verdicts(rows, texts, strength):
    """``in_band`` by numpy from the rows' figures: quartiles of distinct texts, drawn to the language's and to all texts'."""
    counting = {texts[r.doc_id]: r for r in rows if r.n_tokens and not r.base_failed}.values()

    def bounds(group):
        out = {}
        for f in quality.FIGURES:
            low, middle, high = np.percentile([round(r[f] + 1e-12, 3) for r in group], [25, 50, 75])
            half = max((high - low) / 2, quality.LEAST_HALF[f]) * quality.WIDTHS[f]
            out[f] = (middle - half, middle + half)
        return out

    def drawn(group, wider):
        own, w = bounds(group), len(group) / (len(group) + strength)
        return {f: tuple(w * a + (1 - w) * b for a, b in zip(own[f], wider[f])) for f in own}

    overall = bounds(counting)
    coarse = {lang: drawn([r for r in counting if r.lang == lang], overall) for lang in {r.lang for r in counting}}
    fine = {
        key: drawn([r for r in counting if (r.lang, r.length_class) == key], coarse[key[0]])
        for key in {(r.lang, r.length_class) for r in counting}
    }
    out = {}
    for r in rows:
        band = fine.get((r.lang, r.length_class)) or coarse.get(r.lang) or overall
        near = lambda f: (0 if f == "byte_share" else band[f][0] - 1e-9) <= r[f] <= band[f][1] + 1e-9
        out[r.doc_id] = not r.n_tokens or all(near(f) for f in quality.FIGURES)
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_verdicts_of_the_query(spark, folder):
    documents = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op8_tokeniser_fertility"](spark, f"/root/testdata/{folder}").collect()
    want = slow_verdicts(rows, texts, quality.STRENGTH)
    assert {r.doc_id: r.in_band for r in rows} == want
    assert {r.doc_id: r.kept for r in rows} == {r.doc_id: want[r.doc_id] and not r.base_failed for r in rows}


def test_small_groups_are_drawn_to_their_language(spark):
    """Three odd texts of one class don't make a band of their own, and a class's verdicts don't jump with its size."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    odd = spark.range(3).select(F.col("id") + 10**6, F.concat(F.repeat(F.lit("\U0001f600\U0001f601 "), 3000), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rows = quality.judge(docs.union(odd), PATH, BYTES).collect()
    assert not any(r.kept for r in rows if r.doc_id >= 10**6)


@pytest.mark.parametrize(
    "text", ["", "a", "a b\n\n b", " a", "a ", "a  b", "▁a b", "é\tx", "x\n" * 9, "a b c d e f g h " * 3, "漢字 \x00"]
)
def test_ids_and_counts(text):
    model = SentencePieceProcessor(model_file=PATH)
    pieces = quality.PieceIds(PATH)
    assert pieces.ids(text).tolist() == model.encode(text)
    words = text.encode().split()
    assert quality.repeated_words(words, 8) == slow_base(text)[4]
    assert quality.repeated_lines(text) == slow_base(text)[3]


def test_figures():
    pieces = quality.PieceIds(PATH)
    n, chars, share, entropy = quality.fertility("the the the the", pieces)
    assert (n, chars, share, entropy) == (4, 15 / 4, 0.0, 0.0)
    n, _, share, _ = quality.fertility("𝔸", pieces)  # a space and four bytes
    assert (n, share) == (5, 4 / 5)


def test_bands_reject_what_differs(spark):
    """Texts of a table beside copies with symbols after each word, in capitals, and of one word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "text", "lang")
    few = clean.where("doc_id % 40 = 0 and length(text) > 500")
    odd = [
        few.select(F.col("doc_id") + add, text.alias("text"), "lang")
        for add, text in (
            (1_000_000, F.regexp_replace("text", r"(\S+)", "$1###")),
            (2_000_000, F.upper("text")),
            (3_000_000, F.regexp_replace("text", r"\S+", "word")),
        )
    ]
    rows = quality.judge(clean.union(odd[0]).union(odd[1]).union(odd[2]), PATH, BYTES).collect()
    inside = {own: [r.in_band for r in rows if (r.doc_id >= 1_000_000) == own] for own in (False, True)}
    assert sum(inside[False]) >= 0.95 * len(inside[False])  # few documents to learn from
    assert sum(inside[True]) <= 0.5 * len(inside[True]) and len(inside[True]) > 10


def test_copies_of_one_text_leave_the_bands_alone(spark):
    """Copies of one text, and rows that fail the base rules, fill over 80 % of a class: the others are judged as before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en'").select("doc_id", "text", "lang").cache()
    before = {r.doc_id: r for r in quality.judge(clean, PATH, BYTES).collect()}
    group = [r for r in before.values() if r.length_class == 9 and r.kept]
    assert len(group) > 50
    copied = clean.where(F.col("doc_id") == max(group, key=lambda r: r.entropy).doc_id)
    copies = copied.crossJoin(spark.range(5 * len(group)).select("id")).select(F.lit(-1).alias("doc_id"), "text", "lang")
    poor = spark.range(len(group)).select(
        F.lit(-2).alias("doc_id"), F.concat(F.repeat(F.lit("word "), 600), F.col("id")).alias("text"), F.lit("en").alias("lang")
    )
    for r in quality.judge(clean.union(copies).union(poor), PATH, BYTES).collect():
        assert r.doc_id < 0 or r == before[r.doc_id]
        assert r.doc_id != -1 or r.kept


def test_texts_nearly_alike_keep_a_least_width(spark):
    """A text and its 1,000 near copies fill over 80 % of a class: nearly all clean documents of the class stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en'").select("doc_id", "text", "lang").cache()
    group = sorted((r for r in quality.judge(clean, PATH, BYTES).collect() if r.length_class == 9 and r.kept), key=lambda r: r.entropy)
    copies = clean.where(F.col("doc_id") == group[len(group) // 2].doc_id).crossJoin(spark.range(1000).select("id"))
    copies = copies.select(F.lit(-1).alias("doc_id"), F.concat("text", F.lit(" x"), "id").alias("text"), "lang")
    rows = [r for r in quality.judge(clean.union(copies), PATH, BYTES).collect() if r.length_class == 9 and r.doc_id >= 0]
    assert sum(r.in_band for r in rows) >= 0.9 * len(rows) and 4 * len(rows) < 1000


def test_edges(edge, empty, clashing):
    rows = quality.judge(edge, PATH, BYTES).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if not r.n_tokens:
            assert r.in_band and not r.kept and r.entropy is None
    assert quality.judge(empty, PATH, BYTES).count() == 0
    kept = quality.keep_good(clashing, PATH, BYTES)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality.keep_good(empty, PATH, BYTES).count() == 0
