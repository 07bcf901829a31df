"""Ids of a byte-level BPE vocabulary.

The vocabulary is the one of a tokenizers file. Where its ids rise in the order of its
merges, as in byte-level vocabularies that were made in one go, a token's id is its
rank, and the faster of two libraries gives the same ids; tests hold it against the
other. Any other vocabulary is left to the library of its file.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import resident

#: Here a space follows white space, and the text can't simply be cut at each space.
GLUED = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[int, int]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def ranks_of(tokenizer_path: str) -> dict[bytes, int] | None:
    """The bytes of each token with its id as rank; None where ids aren't ranks."""
    with open(tokenizer_path, encoding="utf-8") as file:
        made = json.load(file)
    model, plain = made["model"], {chr(stand_in): byte for byte, stand_in in byte_alphabet().items()}
    if model.get("type") != "BPE" or made.get("normalizer") or (made.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    special = {token["content"] for token in made.get("added_tokens") or []}
    entries = {piece: i for piece, i in model["vocab"].items() if piece not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [entries.get(piece, -1) for piece in merged]
    if any(a >= b for a, b in zip(order, order[1:])) or not all(c in plain for piece in entries for c in piece):
        return None
    return {bytes(plain[c] for c in piece): i for piece, i in entries.items()}


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit numbers: those of ``Tokenizer.encode(text,
    add_special_tokens=False)`` with special strings as text."""

    def __init__(self, tokenizer_path: str):
        ranks = ranks_of(tokenizer_path)
        if ranks:
            import public_tokenizers
            import tiktoken

            own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = own.encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.encode_special_tokens = True
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes() if text else b""


def encoder(tokenizer_path: str) -> Encoder:
    """This Python worker's encoder for the vocabulary; reused by the tasks that the worker runs."""
    return resident(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
