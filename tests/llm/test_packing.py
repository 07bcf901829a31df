import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transitlab.llm.packing import Bins, class_of, pack
from transitlab.llm.tokens import Encoder, ranks_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = [
    "", " ", "  ", "a", " a", "a  b", "a \n b", "it's\t\tfine ", "<|endoftext|> x", "é漢字 \x85 x", "x\x1c y", "1 22  333",
    "don't  'll", "\n\n a\n", "ſ ﬁ 𝔸",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(tokenizer, text):
    assert list(array("I", Encoder(PATH)(text))) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_all_texts(spark, tokenizer):
    encode = Encoder(PATH)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert list(array("I", encode(r.text))) == tokenizer.encode(r.text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    encode, tokenizer = pair()
    assert list(array("I", encode(text))) == tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache
def pair():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return Encoder(PATH), t


def test_long_runs_take_no_longer():
    encode, text = Encoder(PATH), "x" * 400_000
    assert len(encode(text)) > 0


def test_other_vocabularies_are_left_to_their_library(tmp_path, tokenizer):
    assert ranks_of(PATH)
    words = public_tokenizers.path("word_bpe_49k.json")
    assert ranks_of(words) is None
    t = Tokenizer.from_file(words)
    t.encode_special_tokens = True
    assert list(array("I", Encoder(words)("some words"))) == t.encode("some words", add_special_tokens=False).ids


def check_pieces(rows, docs, tokenizer, capacity):
    """Each id in one piece, sequences gapless, padded only where the fill is no power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own, at = sorted(pieces[doc_id], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_whole_table(spark, documents, tokenizer):
    docs = {r.doc_id: r.text for r in documents.collect()}
    rows = pack(documents.repartition(5), PATH, 1024).collect()
    assert check_pieces(rows, docs, tokenizer, 1024) == 0
    whole = sum(r.doc_tokens // 1024 for r in rows if r.start == 0)
    assert len(rows) - whole < 2.2 * len(docs)  # a rest is one piece, or two where it fills a gap


@pytest.mark.parametrize("length, k", [(1024, 1), (513, 1), (512, 2), (342, 2), (341, 3), (1, 1024)])
def test_classes(length, k):
    assert class_of(length, 1024) == k and 1024 / (k + 1) < length <= 1024 / k


def test_bins_take_a_fixed_count_and_the_next_rest_fills_the_gap():
    bins = Bins(10, 100)
    for doc, length in enumerate([4, 6, 13, 9, 4, 2]):
        bins.add(doc, bytes(4 * length))
    bins.close()
    found = list(zip(*(bins.rows[c] for c in ("sequence_id", "doc_id", "start", "length", "offset"))))
    # 4 waits in class 2; 6 is alone in class 1, and its gap takes the rest of 13 and the beginning of 9
    assert found[:4] == [(100, 2, 0, 10, 0), (101, 1, 0, 6, 0), (101, 2, 10, 3, 6), (101, 3, 0, 1, 9)]
    fill = defaultdict(int)
    for sequence, _, _, length, offset in found:
        assert offset == fill[sequence]
        fill[sequence] += length
    assert sorted(fill.values(), reverse=True)[:3] == [10, 10, 10] and sum(fill.values()) == 38


@pytest.mark.parametrize("capacity", [1, 6, 10, 64, 1000])
def test_any_capacity(capacity):
    bins, lengths = Bins(capacity, 0), [doc * 7 % 53 + 1 for doc in range(40)]
    for doc, length in enumerate(lengths):
        bins.add(doc, bytes(4 * length))
    bins.close()
    fill, seen = defaultdict(int), defaultdict(list)
    for sequence, length, offset, doc, start in zip(*(bins.rows[c] for c in ("sequence_id", "length", "offset", "doc_id", "start"))):
        assert offset == fill[sequence]
        fill[sequence] += length
        seen[doc].append((start, start + length))
    assert all(f == capacity or f & (f - 1) == 0 for f in fill.values())
    for doc, length in enumerate(lengths):
        own = sorted(seen[doc])
        assert own[0][0] == 0 and own[-1][1] == length and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_edges(edge, clashing, empty):
    rows = pack(edge, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1  # null: the end id alone
    assert sum(r.length for r in rows if r.doc_id == 4) == 1
    assert sum(r.length for r in rows) == sum(r.length for r in pack(clashing, PATH).collect())
    assert pack(empty, PATH).count() == 0
