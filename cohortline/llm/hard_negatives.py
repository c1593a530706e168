"""Hard negatives by exact inner products with the method of Four Russians.

Components become integers. For each group of eight dimensions an anchor has a table of the sums of all 256 subsets of its eight
components. A candidate is stored as bit planes of its components in two's complement, eight dimensions in a byte; each byte
picks an entry of the group's table, and a score is the sum of the picked entries, shifted by one bit from plane to plane, with
the sign plane counted negative.

Candidates are packed once into pages of the shared folder. Pages are dealt out in strips and anchors in blocks; a task holds
one strip and one block and returns at most the wanted rows of each anchor, so neither side is ever whole in one place. A first
pass finds the positives of the anchors, a second one the negatives below each positive's score.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part, nor do null ids; repeated
rows count once; rows of the anchor's own id are not compared with it; vectors meet only vectors of their length, and those
without components score zero; components of any finite size are computed exactly, and a score beyond a long counts as the
nearest long; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut

SCALE = 256
#: Candidates of one page at most, and anchors whose tables are held at once.
PAGE, TABLES = 1024, 256
#: Candidates of a strip: as many as make ``STRIPS`` strips, between these bounds.
STRIPS, LEAST_STRIP, MOST_STRIP = 1024, 4096, 1 << 20
#: Anchors of a block, about.
BLOCK = 8192
#: Tasks of a pass at most.
TASKS = 1 << 16
LONG = np.iinfo(np.int64)
PAGES = "dim int, n int, planes int, bits binary, ids binary, labels binary"


def whole(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, as longs where all are small and as Python's integers otherwise."""
    x = np.asarray(vectors, np.float64).reshape(len(vectors), -1)
    if np.abs(x).max(initial=0.0) < (1 << 52) / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    for i, row in enumerate(x.tolist()):
        out[i] = [int(v) * scale if abs(v) >= 1 << 53 else floor(v * scale) for v in row]
    return out


def pack(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of bit planes of integers in two's complement, and bytes [plane, group of eight dimensions, row]."""
    n, dim = values.shape
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    planes = 1 + max(max(high, 0).bit_length(), (~min(low, -1)).bit_length())
    padded = np.zeros((-(-dim // 8) * 8, n), values.dtype)
    padded[:dim] = values.T
    bits = np.zeros((planes, len(padded) // 8, n), np.uint8)
    for b in range(planes):
        plane = ((padded >> b) & 1).astype(np.uint8).reshape(-1, 8, n)
        bits[b] = np.packbits(plane, axis=1, bitorder="little")[:, 0]
    return planes, bits


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """Sums [group, byte, anchor] of the components that a byte picks from a group of eight dimensions."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    parts = np.zeros((groups * 8, n), kind)
    parts[:dim] = anchors.T.astype(kind)
    tables = np.zeros((groups, 256, n), kind)
    for j in range(8):
        tables[:, 1 << j:2 << j] = tables[:, :1 << j] + parts[j::8][:, None]
    return tables


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] of packed rows: looked up, shifted and added, the sign plane first."""
    planes, groups, n = bits.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    picked = np.empty_like(total)
    for b in range(planes - 1, -1, -1):
        total += total
        for g in range(groups):
            np.take(tables[g], bits[b, g], axis=0, out=picked, mode="clip")
            if b == planes - 1:
                total -= picked
            else:
                total += picked
    return total


def _kind(anchors: np.ndarray, planes: int):
    """The narrowest numbers in which no sum on the way can overflow."""
    most = (max(1, anchors.shape[1]) * max(1, int(np.abs(anchors).max(initial=0)))) << (planes + 1)
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def _scored(pages: pd.DataFrame, anchors: pd.DataFrame, scale: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end of the anchors whose tables are held, ids and labels of a page, and its scores [row, anchor]."""
    for start in range(0, len(anchors), TABLES):
        end = min(start + TABLES, len(anchors))
        vectors, tables = whole(list(anchors["v"].iloc[start:end]), scale), {}
        for p in pages.itertuples(index=False):
            kind = _kind(vectors, p.planes)
            if kind not in tables:
                tables[kind] = subset_sums(vectors, kind)
            bits = np.frombuffer(p.bits, np.uint8).reshape(p.planes, -(-p.dim // 8), p.n)
            found = scores(tables[kind], bits)
            if kind is object:
                found = np.clip(found, int(LONG.min), int(LONG.max)).astype(np.int64)
            yield start, end, np.frombuffer(p.ids, np.int64), np.frombuffer(p.labels, np.int64), found


class Best:
    """The ``k`` best (score, id) of each slot so far; equal scores go to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        #: The score a pair must reach, and the id it must stay below where it only equals that score.
        self.least, self.below, self.k = least.copy(), np.full(len(least), LONG.max), k
        self.slot, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        late = (score > self.least[slot]) | (score == self.least[slot]) & (ident <= self.below[slot])
        if not late.any():
            return
        slot = np.concatenate([self.slot, slot[late]])
        score = np.concatenate([self.score, score[late].astype(np.int64)])
        ident = np.concatenate([self.ident, ident[late]])
        order = np.lexsort((ident, ~score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.least[slot[last]], self.below[slot[last]] = score[last], ident[last]
        kept = rank < self.k
        self.slot, self.score, self.ident = slot[kept], score[kept], ident[kept]


def _limits(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Bounds for scores of this kind, whose range all scores are well inside of."""
    edge = np.iinfo(kind)
    return np.clip(values, edge.min, edge.max).astype(kind)


def _taking_part(table: DataFrame, is_anchor: Column, label: Column, key: str, vector: str) -> DataFrame:
    """Distinct rows (id, label, v, asks)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    good = table.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return good.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), doubles.alias("v"),
                       F.coalesce(is_anchor, F.lit(False)).alias("asks")).distinct()


def _pages(rows: DataFrame, scale: int) -> DataFrame:
    """Candidates (id, label, v) packed, up to ``PAGE`` of one length in a page."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGE):
                frame, out = batch.slice(at, PAGE).to_pandas(), []
                for dim, part in frame.groupby(frame["v"].map(len)):
                    planes, bits = pack(whole(list(part["v"]), scale))
                    ids, labels = (part[c].to_numpy(np.int64).tobytes() for c in ("id", "label"))
                    out.append({"dim": dim, "n": len(part), "planes": planes, "bits": bits.tobytes(), "ids": ids, "labels": labels})
                schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("planes", pa.int32()), ("bits", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary())])
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, PAGES)


def _cells(pages: DataFrame, anchors: DataFrame, function, schema: str) -> DataFrame:
    """``function(pages, anchors)`` for every strip of candidates and block of anchors of one length of vectors."""
    total = pages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = min(MOST_STRIP, max(LEAST_STRIP, -(-total // STRIPS)))
    strips, blocks = max(1, -(-total // width)), max(1, -(-anchors.count() // BLOCK))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell, tasks = ["dim", "block", "strip"], min(TASKS, strips * blocks)
    dealt = pages.withColumn("strip", part("ids", strips)).withColumn("block", each(blocks)).repartition(tasks, *cell)
    asked = anchors.withColumn("block", part("anchor", blocks)).withColumn("strip", each(strips)).repartition(tasks, *cell)
    return dealt.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(function, schema)


def _positives(pages: DataFrame, anchors: DataFrame, k: int, scale: int) -> DataFrame:
    """Rows (anchor, place, positive_id, score): the k best rows of each anchor's label."""
    def run(strip: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = Best(np.full(len(asked), LONG.min), k)
        own, labels = asked["id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
        for start, end, ids, of_row, score in _scored(strip, asked, scale):
            fits = (of_row[:, None] == labels[start:end]) & (score >= _limits(best.least[start:end], score.dtype))
            row, column = np.nonzero(fits)
            other = ids[row] != own[start:end][column]
            row, column = row[other], column[other]
            best.add(column + start, score[row, column], ids[row])
        return pd.DataFrame({"anchor": asked["anchor"].to_numpy(np.int64)[best.slot], "positive_id": best.ident, "score": best.score})

    found = _cells(pages, anchors, run, "anchor long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _negatives(pages: DataFrame, anchors: DataFrame, positives: int, k: int, least_percent: int, scale: int) -> DataFrame:
    """The k best rows of other labels in the window below each positive; ``anchors`` has the positives as ``ids`` and ``found``."""
    def run(strip: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        high, low = np.full((len(asked), positives), LONG.min), np.full((len(asked), positives), LONG.max)
        named = np.zeros((len(asked), positives), np.int64)
        for i, (ids, found) in enumerate(zip(asked["ids"], asked["found"], strict=True)):
            named[i, :len(ids)], high[i, :len(ids)] = ids, found
            low[i, :len(ids)] = [-(-least_percent * int(x) // 100) for x in found]
        best = Best(low.ravel(), k)
        own, labels = asked["id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
        top = high.max(axis=1, initial=LONG.min)
        for start, end, ids, of_row, score in _scored(strip, asked, scale):
            least = best.least.reshape(-1, positives)[start:end].min(axis=1)
            fits = (score >= _limits(least, score.dtype)) & (score <= _limits(top[start:end], score.dtype)) & (of_row[:, None] != labels[start:end])
            row, column = np.nonzero(fits)
            other = ids[row] != own[start:end][column]
            row, column = row[other], column[other]
            value, ident = score[row, column], ids[row]
            for j in range(positives):
                inside = value <= high[start:end, j][column]
                best.add((column[inside] + start) * positives + j, value[inside], ident[inside])
        row, place = best.slot // positives, best.slot % positives
        return pd.DataFrame({
            "anchor": asked["anchor"].to_numpy(np.int64)[row], "place": place, "anchor_id": own[row], "positive_id": named[row, place],
            "negative_id": best.ident, "positive_score": high[row, place], "negative_score": best.score,
        })

    found = _cells(pages, anchors, run, "anchor long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(rows: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Rows (query_id, vec_id, score): the k best of ``rows`` (id, v) for each of ``queries`` (id, v), by exact scores of any size.

    For tables of both sides that another search cannot take; every query meets every row, in blocks.
    """
    pages = cut_lineage(_pages(rows.select("id", F.lit(0).cast("long").alias("label"), "v"), scale))
    anchors = cut_lineage(queries.select(F.size("v").alias("dim"), "id", F.lit(0).cast("long").alias("label"), "v", F.monotonically_increasing_id().alias("anchor")))
    found = _positives(pages, anchors, k, scale).join(anchors.select("anchor", "id"), "anchor")
    out = cut_lineage(found.select(F.col("id").alias("query_id"), F.col("positive_id").alias("vec_id"), "score"))
    drop_cut(pages, anchors)
    return out


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80,
                   key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best rows of the same label. The negatives of a positive are the best rows of other labels with
    a score between ``least_percent`` of the positive's and all of it.
    """
    rows = cut_lineage(_taking_part(table, is_anchor, label, key, vector))
    pages = cut_lineage(_pages(rows.select("id", "label", "v"), scale))
    anchors = cut_lineage(rows.where("asks").select(F.size("v").alias("dim"), "id", "label", "v", F.monotonically_increasing_id().alias("anchor")))
    found = _positives(pages, anchors, positives, scale)
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("best"))
    asked = cut_lineage(anchors.join(listed, "anchor").select(*anchors.columns, F.col("best.positive_id").alias("ids"), F.col("best.score").alias("found")))
    out = cut_lineage(_negatives(pages, asked, positives, negatives, least_percent, scale))
    drop_cut(rows, pages, anchors, asked)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
