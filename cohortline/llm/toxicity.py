"""Toxicity scores from FTRL-proximal logistic regression over hashed word features.

Features are the hashed words of a text and their stems, pairs of neighbours, and pairs with one word between them; each
counts once for a text. FTRL keeps a rate for each coordinate, and its L1 term leaves few weights, which travel to all tasks as two short
arrays. The fit reads a bounded sample of labelled rows, ``TRAIN_ROWS`` in hash order of their ids; every text is scored whole.

Defined cases: null and empty texts have the score of no features; labels that are null are not used, and a document with
several labels has the largest; repeated rows are scored each; a fit without rows of both classes predicts its base rate;
other columns stay, and columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.common import WordCache, appended, arrow_schema, key_as_text, released, sliced

#: Rows of the fit at most; below this all labelled rows are used.
TRAIN_ROWS = 12_000
BITS = 20
THRESHOLD = 0.3
#: Letters at the beginning of a word that count as a stem.
STEMS = (4, 5, 6)
#: Bytes of hashed words that a task keeps, twice.
CACHE = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
EDGES = ".,;:!?()[]{}\"'|#*$%&<>"


def _hash(words: list[str]) -> list[bytes]:
    """The hashes of a word and of its stems, which the inflected forms of a word share."""
    digest, out = xxhash.xxh64_intdigest, []
    for word in words:
        word = word.strip(EDGES)
        out.append(pack("<4Q", digest(word), *[digest(f"{word[:n]}~") if len(word) >= n else 0 for n in STEMS]))
    return out


def features(texts: list[str | None], bits: int = BITS, known: WordCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of the texts, with repetitions; ``known`` keeps words of earlier calls."""
    known = WordCache(CACHE) if known is None else known
    lists = [(x or "").lower().split() for x in texts]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    row = np.repeat(np.arange(len(lists)), size)
    units = np.frombuffer(b"".join(known.values([w for x in lists for w in x], _hash)), "<u8").reshape(-1, 1 + len(STEMS))
    shift = np.uint64(64 - bits)
    h = units[:, 0]
    rows, found = [row], [h * MIX >> shift]
    for stem in units.T[1:]:
        there = stem != 0
        rows.append(row[there])
        found.append(stem[there] * MIX >> shift)
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        same = row[gap:] == row[:-gap]
        mixed = (h[:-gap] * np.uint64(odd) ^ h[gap:] >> np.uint64(7)) * MIX + h[gap:] * np.uint64(odd)
        rows.append(row[gap:][same])
        found.append((mixed >> shift)[same])
    return np.concatenate(rows), np.concatenate(found).astype(np.int32)


@dataclass(frozen=True)
class Weights:
    """The bias and the coordinates that are not zero."""

    bias: float
    index: np.ndarray
    value: np.ndarray
    bits: int = BITS

    def table(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float32)
        full[self.index] = self.value
        return full


def score(table: np.ndarray, bias: float, texts: list[str | None], bits: int = BITS, known: WordCache | None = None) -> np.ndarray:
    row, index = features(texts, bits, known)
    hit = table[index] != 0
    pair = np.unique(row[hit] << np.int64(32) | index[hit])
    total = np.bincount(pair >> 32, weights=table[pair & 0xFFFFFFFF], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0) -> Weights:
    """Follow the regularised leader over the rows' features, in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rate = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bias, seen = float(np.log(rate / (1 - rate))), 1.0

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, y in zip(rows, labels.tolist(), strict=True):
            w = weight(i)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w.sum()) + bias))))
            g = p - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            seen += g * g
            bias -= 0.05 * g / np.sqrt(seen)
    kept = np.flatnonzero(np.abs(z) > l1)
    return Weights(bias, kept.astype(np.int32), weight(kept).astype(np.float32), bits)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(key_as_text(key).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Weights:
    """Weights from at most ``train_rows`` labelled documents that are not held out.

    The sample has a row bound, so it is broadcast to find its texts, and its features, not its texts, reach the one task
    that learns; the weights are bounded by the number of coordinates.
    """
    sample = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(key).agg(F.max(label).cast("double").alias("_y"))
        .withColumn("_order", F.xxhash64(key)).orderBy("_order", key).limit(train_rows)
    )
    known = docs.select(key, text).join(F.broadcast(sample), key).select(text, "_y", "_order")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCache(CACHE)
        for batch in sliced(batches, text):
            row, index = features(batch.column(text).to_pylist(), known=known)
            pair = np.unique(row << np.int64(32) | index)
            ends = np.searchsorted(pair >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("_y"), batch.column("_order")], names=["_x", "_y", "_order"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order", kind="stable")
        found = ftrl(list(rows["_x"]), rows["_y"].to_numpy())
        return pd.DataFrame({"i": np.r_[-1, found.index], "w": np.r_[found.bias, found.value]})

    one = known.mapInArrow(released(hashed), "_x array<int>, _y double, _order long").groupBy(F.lit(0).alias("_all")).applyInPandas(learn, "i long, w double")
    got = {r["i"]: r["w"] for r in one.collect()}
    bias = got.pop(-1, 0.0)
    index = np.array(sorted(got), np.int32)
    return Weights(bias, index, np.array([got[int(i)] for i in index], np.float32))


def scored(docs: DataFrame, weights: Weights, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the probability of label 1 in ``out``; only the text is read for it."""
    schema = appended(docs.schema, T.StructField(out, T.DoubleType(), False))
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = weights.table(), WordCache(CACHE)
        for batch in sliced(batches, text):
            found = pa.array(score(table, weights.bias, batch.column(text).to_pylist(), weights.bits, known), pa.float64())
            yield pa.RecordBatch.from_arrays([found if f.name == out else batch.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(released(run), schema)
