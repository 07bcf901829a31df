import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from transitlab.llm.viterbi import Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def names():
    model = SentencePieceProcessor(model_file=PATH)
    size = model.get_piece_size()
    return {model.id_to_piece(i): i for i in range(3, size) if not model.is_byte(i)}


def best(pieces, names, text):
    """The best score of any path over a whole text, with no thought of words or batches."""
    marks = [{" ": "▁", "▁": None}.get(c, c) for c in " " + text]
    scores = [0.0]
    for end in range(1, len(marks) + 1):
        char = "▁" if marks[end - 1] is None else marks[end - 1]
        own = names.get(marks[end - 1])
        top = scores[-1] + (pieces.score_of[own] if own else pieces.byte_score * len(char.encode()))
        for size in range(2, min(pieces.longest, end) + 1):
            part = marks[end - size : end]
            if None not in part and (i := names.get("".join(part))):
                top = max(top, scores[end - size] + pieces.score_of[i])
        scores.append(top)
    return scores[-1]


def score(pieces, ids):
    byte_ids = set(pieces.byte_ids)
    return sum(pieces.byte_score if i in byte_ids else pieces.score_of[i] for i in ids)


def test_paths_are_best_and_exact(pieces, names):
    r = random.Random(1)
    alphabet = [*"aeinrst thou", "  ", "é", "漢", "▁", "\n", "𝔸", "\x00", "ing", "tion", " the"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(1, 90 if i % 9 == 0 else 12))) for i in range(400)]
    texts += ["x" * 300, " lead", "trail ", "the" * 40]
    for text, raw in zip(texts, pieces.encode(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert pieces.decode(ids) == text
        assert abs(score(pieces, ids) - best(pieces, names, text)) < 1e-6


def test_a_full_memory_changes_nothing(pieces):
    texts = [" ".join(f"word{i}{j}" for j in range(30)) for i in range(20)]
    tight = Pieces(PATH, limit=10)
    assert [tight.encode([t])[0] for t in texts] == pieces.encode(texts)


def test_round_trip_of_tables(documents, edge, empty, clashing):
    for docs in (documents, edge, clashing):
        encoded = encode(docs, PATH)
        assert encoded.where("not exact").count() == 0
        back = sorted((str(r.doc_id), r.text) for r in decode(encoded, PATH).collect())
        assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert encode(empty, PATH).count() == 0
