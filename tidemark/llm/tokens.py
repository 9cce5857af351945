"""Byte-level BPE ids.

Texts are encoded whole: measured over new words, which a corpus never runs out of, that takes less than half the time of a
memory of words. The ids are those of the tokenizers file of the vocabulary, made by tiktoken: the added tokens of that file
are cut out of a text first and keep their own ids, as ``tokenizers`` does with its default settings.
"""

from __future__ import annotations

import base64
import json
import os
import sys
from array import array

import numpy as np
import tiktoken


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the tokenizers file (.json) beside a rank file; none without one."""
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens of {described} match by more than their text")
    return {t["content"]: t["id"] for t in tokens}


class ByteBpe:
    """Little-endian unsigned 32-bit ids as bytes: ``encode_text`` of a text with added tokens, ``encode`` of plain text."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path or default_vocabulary(), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._added = added_tokens(path or default_vocabulary())
        #: The greatest id of the vocabulary.
        self.most_id = max([*ranks.values(), *self._added.values()])
        self._codec = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self._added)

    def encode_text(self, text: str) -> bytes:
        if any(token in text for token in self._added):
            return self._packed(self._codec.encode(text, allowed_special="all"))
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        return self._packed(self._codec.encode_ordinary(text))

    @staticmethod
    def _packed(found: list[int]) -> bytes:
        ids = array("I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def decode(self, ids: bytes) -> str:
        return self._codec.decode(np.frombuffer(ids, "<u4").tolist())


_CODECS: dict[str, ByteBpe] = {}


def codec(path: str | None = None) -> ByteBpe:
    """One codec for each vocabulary and Python worker."""
    key = path or ""
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(path)
    return _CODECS[key]
