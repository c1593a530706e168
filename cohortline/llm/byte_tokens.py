"""Token ids of a byte-level BPE vocabulary file.

Ids are those the ``tokenizers`` library gives without added special tokens. Texts go whole through a coder that is faster; those
with a run of white space too long for its split pattern go through the library itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from cohortline.llm.bpe import byte_alphabet

#: Fixed value: the split pattern of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the split pattern would have to go back over, character by character.
LONG_RUN = regex.compile(r"\s{10000}")


class ByteBpe:
    """Encoder for one vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        value = {c: b for b, c in enumerate(byte_alphabet())}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(value.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        self.coding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        self.path = path

    def _ids(self, text: str) -> list[int]:
        if len(text) >= 10_000 and LONG_RUN.search(text):
            return Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids
        if "<|" in text and self.special.search(text):
            return self.coding.encode(text, allowed_special="all")
        return self.coding.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit numbers; none for a null or empty text."""
        return [np.array(self._ids(text), "<i4").tobytes() if text else b"" for text in texts]


@cache
def coder(path: str) -> ByteBpe:
    """One coder for each worker process and file."""
    return ByteBpe(path)
