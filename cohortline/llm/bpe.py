"""Byte-pair encoding and decoding with word ends.

A vocabulary file in the ``tokenizers`` JSON format gives tokens, merges and special tokens. Text is cut at special
tokens, composed (NFC), lower-cased and split into words; each word is encoded on its own.

The merges work on contiguous arrays: the token ids between part boundaries, and beside them the rank of each adjacent
pair. The smallest rank is found by scanning, its boundary deleted, and the two neighbouring ranks are looked up again.
New words of one length are rows of one matrix and take these steps together; a word leaves the matrix when no pair is
left. Words beyond ``SHORT_WORD`` bytes use the same rule with a heap over linked parts, since scanning would cost the
square of their length.

Defined cases: a null text is encoded as an empty one; an empty text has no ids and decodes to an empty text; repeated
rows are encoded each; other columns stay, and columns named as an output are replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from cohortline.llm.common import WordCache, appended, arrow_schema, released, sliced

#: Words up to this many bytes are merged by scanning the rank array.
SHORT_WORD = 96
#: Words of one length that are merged together.
ROWS = 1 << 14
#: No pair.
NO_RANK = 1 << 30
#: White space as the split pattern knows it; str.split() would also cut at these four separators.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Beyond these characters the library normalises and splits, since its Unicode version decides.
OTHER = regex.compile("[^\x00-\u017f\u2010-\u2027]|\u0130")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Pairs:
    """Rank and merged id of a pair of ids, for whole arrays, from an open-addressing table."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        bits = max(8, (4 * len(merges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.joined = np.array([m[2] for m in merges] or [0], np.int32)
        for rank, (a, b, _) in enumerate(merges):
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.key[at] >= 0:
                at = at + 1 & self.last
            self.key[at], self.rank[at] = a << 32 | b, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        there = self.key[at]
        out = np.where(there == key, self.rank[at], NO_RANK).astype(np.int32)
        open_ = np.nonzero((there != key) & (there >= 0))
        while len(open_[0]):
            at[open_] = at[open_] + 1 & self.last
            there = self.key[at[open_]]
            hit = there == key[open_]
            out[tuple(x[hit] for x in open_)] = self.rank[at[open_]][hit]
            going = ~hit & (there >= 0)
            open_ = tuple(x[going] for x in open_)
        return out


def merged(ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Merge words of equal length, one in each row of ``ids``; the results as little-endian 32-bit ids."""
    out: list = [b""] * len(ids)
    place = np.arange(len(ids))
    ranks = pairs.ranks(ids[:, :-1], ids[:, 1:])
    while len(place):
        width = ids.shape[1]
        at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(ids), np.int64)
        best = ranks[np.arange(len(ids)), at] if width > 1 else np.full(len(ids), NO_RANK)
        if (over := best == NO_RANK).any():
            data, size = ids[over].astype("<i4").tobytes(), 4 * width
            for i, row in enumerate(place[over].tolist()):
                out[row] = data[i * size:(i + 1) * size]
            going = ~over
            ids, ranks, place, at, best = ids[going], ranks[going], place[going], at[going], best[going]
            if not len(place):
                break
        row = np.arange(len(ids))
        ids[row, at] = pairs.joined[best]
        after = np.arange(width - 1)
        ids = np.take_along_axis(ids, after + (after > at[:, None]), axis=1)
        after = np.arange(width - 2)
        ranks = np.take_along_axis(ranks, after + (after >= at[:, None]), axis=1)
        right, left = np.flatnonzero(at < width - 2), np.flatnonzero(at > 0)
        ranks[right, at[right]] = pairs.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        ranks[left, at[left] - 1] = pairs.ranks(ids[left, at[left] - 1], ids[left, at[left]])
    return out


def merged_long(ids: list[int], rank_of: dict[tuple[int, int], int], joined: list[int]) -> list[int]:
    """The same merges, smallest rank and then leftmost first, from a heap over linked parts."""
    n = len(ids)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank_of[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank_of]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = joined[rank]
        alive[j] = False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n and (p := (ids[k], ids[right[k]])) in rank_of:
                heapq.heappush(heap, (rank_of[p], k, *p))
    return [x for x, kept in zip(ids, alive, strict=True) if kept]


class WordBpe:
    """Encoder for one vocabulary file with lower-casing, word splitting and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.joined = [vocab[a + b] for a, b in merges]
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        # the file's split pattern, with the white space class spelled out
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.splitter = Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, number in [*vocab.items(), *self.specials.items()]:
            self.tokens[number] = token
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.words, self.chunks = WordCache(16 << 20), WordCache()

    def _words(self, words: list[str]) -> list[bytes]:
        data = [w.encode("utf-8") for w in words]
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(data):
            by_length.setdefault(len(word), []).append(i)
        out: list = [b""] * len(words)
        for length, rows in by_length.items():
            for start in range(0, len(rows), ROWS):
                some = rows[start:start + ROWS]
                codes = np.frombuffer(b"".join([data[i] for i in some]), np.uint8).reshape(len(some), length)
                ids = self.inner[codes]
                ids[:, -1] = self.last[codes[:, -1]]
                if length <= SHORT_WORD:
                    done = merged(ids, self.pairs)
                else:
                    done = [np.array(merged_long(x.tolist(), self.rank_of, self.joined), "<i4").tobytes() for x in ids]
                for i, value in zip(some, done, strict=True):
                    out[i] = value
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split, find = self.splitter.pre_tokenize_str, self.word.findall
        found = [[w for w, _ in split(c)] if not c.isascii() and OTHER.search(c) else find(c) for c in chunks]
        ids = iter(self.words.values([w for words in found for w in words], self._words))
        return [next(ids) if len(words) == 1 else b"".join([next(ids) for _ in words]) for words in found]

    def normalised(self, text: str) -> str:
        """Composed and in lower case, character by character."""
        if text.isascii():
            return text.lower()
        if not OTHER.search(text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; none for a null."""
        special, whole = {}, []
        for i, text in enumerate(texts):
            if text and "<|" in text and self.special.search(text):
                special[i] = [p for p in self.special.split(text) if p]
                whole += [p for p in special[i] if p not in self.specials]
            else:
                whole.append(text or "")
        parts = iter(self._plain(whole))
        return [
            b"".join([pack("<i", self.specials[p]) if p in self.specials else next(parts) for p in special[i]]) if i in special else next(parts)
            for i in range(len(texts))
        ]

    def _plain(self, texts: list[str]) -> list[bytes]:
        lists = [[t] if SEPARATORS.search(t) else t.split() for t in map(self.normalised, texts)]
        ids = self.chunks.values([c for chunks in lists for c in chunks], self._chunks)
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


@cache
def coder(path: str) -> WordBpe:
    """One coder for each worker process and file."""
    return WordBpe(path)


def _replaced(batch: pa.RecordBatch, schema: pa.Schema, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([column if f.name == name else batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the token ids of ``text`` in ``ids``, an array of integers; null texts count as empty."""
    schema = appended(docs.schema, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        for batch in sliced(batches, text):
            found = encoder.encode(batch.column(text).to_pylist())
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
            yield _replaced(batch, arrow, ids, pa.ListArray.from_arrays(pa.array(offsets), values).cast(arrow.field(ids).type))
        encoder.words.clear()
        encoder.chunks.clear()

    return docs.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the tokens of ``ids``, joined by spaces, in ``text``; null ids count as none.

    A lookup in the vocabulary, which is a constant of the plan, of bounded size: no Python runs.
    """
    tokens = F.split(F.lit("\0".join(coder(path).tokens)), "\0", -1)
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.get(tokens, i)), " ")
    return encoded.withColumn(text, F.coalesce(joined, F.lit("")))
