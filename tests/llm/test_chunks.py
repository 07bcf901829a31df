import hashlib

import numpy as np
import pytest

from transitlab.llm import chunks
from transitlab.llm.chunks import Chunking, as_text, containment
from transitlab.llm.queries import QUERIES


def slow_ends(c, raw):
    h, hashes = 0, []
    for b in raw:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    at, out = 0, []
    while at < len(raw):
        for end in range(at + c.least, at + c.greatest + 1):
            size = end - at
            bits = c.strict_bits if size < c.normal else c.loose_bits
            if end >= len(raw) or size == c.greatest or hashes[end - 1] >> (32 - bits) == 0:
                break
        at = min(end, len(raw))
        out.append(at)
    return out


def slow_table(rows, c):
    """rows: (doc_id, text) with distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = c.digests(text), c.digests(edited), c.digests(following)
        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other),
            containment(own, other), containment(own, after),
        )
    return out


def table_of(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_query_is_brute_force(spark, small, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert table_of(QUERIES["op6_gear_chunks"](spark, small)) == slow_table(rows, Chunking())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_any_number_of_parts(spark, documents, parts):
    docs = documents.where("doc_id % 7 = 0")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert table_of(chunks.edited_likeness(docs.repartition(4), parts=parts)) == slow_table(rows, Chunking())


def test_boundaries(documents):
    c = Chunking()
    for r in documents.limit(30).collect():
        assert c.ends(r.text.encode()) == slow_ends(c, r.text.encode())
    for raw in (b"", b"a", bytes(1000), b"ab" * 700):
        assert c.ends(raw) == slow_ends(c, raw)


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 5000, np.uint8).tobytes()
    whole = Chunking().ends(raw)
    monkeypatch.setattr(chunks, "BLOCK", 137)
    assert Chunking().ends(raw) == whole


def test_shift_keeps_the_chunks(documents):
    c = Chunking()
    text = max((r.text for r in documents.collect()), key=len)
    assert containment(c.digests(text), c.digests("A new beginning. " + text)) > 0.97
    assert containment(c.digests(text), c.digests(text)) == 1.0
    assert containment(c.digests(""), c.digests("")) == 1.0 and containment(c.digests(""), c.digests(text)) == 0.0


def test_edges(spark, edge, empty, clashing):
    rows = chunks.edited_likeness(edge).collect()
    assert len(rows) == edge.count()
    by_text = {}
    for r in chunks.fingerprints(edge).collect():
        by_text.setdefault((r.doc_id, r.fingerprint), 0)
    assert {(r.doc_id, r.fingerprint) for r in rows} == set(by_text)
    assert all(r.near_next == 0 or r.fingerprint == "" for r in rows if r.doc_id is None)
    assert chunks.edited_likeness(clashing).count() == len(rows)
    assert chunks.edited_likeness(empty).count() == 0
    one = chunks.edited_likeness(spark.createDataFrame([(5, "abcd" * 30)], "doc_id long, text string")).first()
    assert one.near_next == 1.0
