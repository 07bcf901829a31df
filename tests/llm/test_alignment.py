import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from transitlab.llm.alignment import Radix, align, counted, expand, merge, opened, squeeze

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    stand_ins = {**{b: b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}}
    for byte in range(256):
        if byte not in stand_ins:
            stand_ins[byte] = 256 + sum(x >= 256 for x in stand_ins.values())
    byte_of = {chr(c): b for b, c in stand_ins.items()}
    entry = {i: bytes(byte_of.get(c, 0) for c in piece) for piece, i in a.get_vocab().items()}

    def encode(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        pieces = b.encode(text)
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        return ids, [entry[i] for i in ids], pieces, of_b

    return encode


def brute(rows, encode):
    """Whole texts, links from sets of ends, counts in one dictionary."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        ids, of_a, pieces, of_b = encode(text) if text else ([], [], [], [])
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        ends_a = {end: i for i, end in enumerate(np.cumsum([len(x) for x in of_a]).tolist())}
        ends_b = {end: i for i, end in enumerate(np.cumsum([len(x) for x in of_b]).tolist())}
        shared = sorted(ends_a.keys() & ends_b.keys())
        links = [(pieces[ends_b[e]], ids[ends_a[e]]) for e in shared]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in shared:
            k, m = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, ids[i:k])) + "|" + ",".join(map(str, pieces[j:m])))
            i, j = k, m
        docs.append((doc_id, ids, pieces, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (b, _), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((d, len(a), len(b), len(x), len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), sha)
         for d, a, b, x, sha in docs), key=str,
    )


def result(df, **options):
    return sorted(map(tuple, align(df, A, B, **options).collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


TEXTS = [
    " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "it's\t\tfine ", "<|endoftext|> <s> </s> <unk> <0x41>", "é漢字 \x85 x", "x\x1c y",
    "▁", "a▁b", "\x00 \x00", "don't  'll", "\n\n a\n", "ſ ﬁ 𝔸 é", "a" * 3000, "　x　 y", "﻿x", "​x  y",
]


def test_odd_texts(spark, both):
    rows = [(i, text) for i, text in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows, both)


def test_whole_table(spark, documents, both):
    assert result(documents.repartition(5)) == brute(pairs(documents), both)


def test_many_spills_and_passes(spark, documents, both):
    some = documents.limit(60).repartition(7)
    assert result(some, spill_links=500, fan=2, partitions=3) == brute(pairs(some), both)


def test_edges(edge, clashing, empty, both):
    want = brute(pairs(edge), both)
    assert result(edge) == want
    assert result(clashing) == want
    assert result(empty) == []


def test_columns_return():
    columns = [np.array([0, 5, 300]), np.array([], np.int64), np.array([2**40])]
    assert [x.tolist() for x in expand(squeeze(*columns))] == [[0, 5, 300], [], [2**40]]


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_merge_counts_and_maxima(fan):
    rng, radix, heads, want = np.random.default_rng(1), Radix(1, 10, 8), [], Counter()
    for _ in range(17):
        links = rng.integers(0, 8, 50) << 32 | rng.integers(0, 10, 50)
        codes, sums = np.unique(radix.codes(links), return_counts=True)
        want.update(dict(zip(codes.tolist(), sums.tolist())))
        heads.append(squeeze(np.diff(codes, prepend=0), sums))
    codes, counts, best = counted(heads, 10, fan)
    assert dict(zip(codes.tolist(), counts.tolist())) == want
    for code, count, is_best in zip(codes, counts, best):
        assert is_best == (count == max(n for c, n in want.items() if c // 10 == code // 10))
    assert sum(len(c) for c, _ in merge([opened(h) for h in heads], 10)) == len(want)
