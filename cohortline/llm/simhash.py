"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

A fingerprint has 64 bits over the hashes of a document's word shingles. Two fingerprints within ``RADIUS`` bits agree in
at least one of RADIUS + 1 blocks of bits, so distinct fingerprints meet in buckets of equal blocks. A bucket with more than
``BUCKET`` fingerprints is parted again by blocks of its remaining bits, which loses no link, and what is still larger is
compared in tiles.

Inside a task the fingerprints of a bucket lie vertically: one bit plane for each bit, 64 fingerprints in a word. Row i meets
row i + lag for all rows at once; the differing bits go through carry-save counters (ones, twos, and a sticky four), and a word
is abandoned once all its 64 distances exceed the radius. Found links are reduced to a spanning forest before they leave.

Defined cases: a null text counts as empty; a document without words has fingerprint zero and links like any other; equal
fingerprints are one node, so copies cost nothing; null document ids form no group of their own kind, they are kept as
they are; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.sizing import cut_lineage, drop_cut, marked
from cohortline.llm.common import arrow_schema, free_name, released, sliced
from cohortline.llm.components import components

RADIUS = 3
SEED = 42
#: Fingerprints of a bucket that are compared as they are; above, the bucket is parted.
BUCKET = 1024
#: Times a bucket is parted by bits before it is compared in tiles.
DEPTH = 4
#: Keys of removed documents, 8 bytes or little more each, that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Shingles hashed at a time, so that a long document needs no more.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of one text: bits set in over half of its shingle hashes."""
    parts = (text or "").encode("utf-8").lower().split()
    n = len(parts)
    if n == 0:
        return 0
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n <= words:
        hashes = np.array([digest(whole, SEED)], np.uint64)
        count, total = _bit_counts(hashes), 1
    else:
        lengths = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - words + 1].tolist()
        ends = ends[words - 1:].tolist()
        count, total = np.zeros(64, np.int64), len(starts)
        for at in range(0, total, CHUNK):
            hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], np.uint64)
            count += _bit_counts(hashes)
    return int(np.packbits(2 * count > total, bitorder="little").view(np.int64)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp) with the signed fingerprint of each whole text."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = [fingerprint(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(released(run), schema)


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    size = [len(free) // parts + (i < len(free) % parts) for i in range(parts)]
    ends = np.cumsum([0, *size])
    return [free[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _parted(rows: DataFrame, choices: list[tuple[str, list[int]]], parts: int) -> DataFrame:
    """Each row once for every block of the bits that its bucket's path has left free.

    ``choices`` has the paths of this depth with their free bits; a bucket is (path, bits fixed so far).
    """
    options = []
    for path, free in choices:
        for i, block in enumerate(_blocks(free, parts)):
            fixed = sorted(set(range(64)) - set(free) | set(block))
            options.append(F.when(F.col("path") == path, F.struct(F.lit(f"{path}{i}").alias("path"), F.col("fp").bitwiseAND(F.lit(_mask(fixed))).alias("bits"))))
    each = rows.withColumn("o", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())))
    return each.select("fp", F.col("o.path").alias("path"), F.col("o.bits").alias("bits"))


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes over the values, 64 values in a word, with one word of padding for shifts."""
    n = len(values)
    words = (n + 63) // 64 + 2
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def close_at_lag(plane: np.ndarray, meets: np.ndarray, lag: int, radius: int = RADIUS) -> np.ndarray:
    """Rows i, among the set bits of ``meets``, whose distance to row i + lag is at most ``radius`` (3 at most)."""
    shift, over = divmod(lag, 64)
    word = np.flatnonzero(meets)
    last = plane.shape[1] - 1
    ones, twos = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    four = ~meets[word]
    for bit in range(64):
        low = plane[bit, np.minimum(word + shift, last)]
        if over:
            low = (low >> np.uint64(over)) | (plane[bit, np.minimum(word + shift + 1, last)] << np.uint64(64 - over))
        differs = plane[bit, word] ^ low
        carry = ones & differs
        ones ^= differs
        four |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            live = ~four != 0
            if not live.all():
                word, ones, twos, four = word[live], ones[live], twos[live], four[live]
                if not len(word):
                    return np.zeros(0, np.int64)
    near = ~four
    if radius < 3:
        near &= ~(ones & twos) if radius == 2 else ~twos if radius == 1 else ~(ones | twos)
    out = np.unpackbits(near.view(np.uint8).reshape(len(word), 8), axis=1, bitorder="little")
    row, lane = np.nonzero(out)
    return word[row] * 64 + lane


class Forest:
    """Labels of joined rows; ``join`` returns the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def labels(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        label, kept = self.labels(), []
        open_ = label[a] != label[b]
        for i, j in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((i, j))
        return kept


def linked(values: np.ndarray, bucket: np.ndarray, cross: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between values of equal buckets (given sorted by bucket).

    With ``cross`` only pairs of unequal sides are compared (tiles of two parts of one large bucket).
    """
    n = len(values)
    plane, forest, out = planes(values), Forest(n), []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    most = int(np.diff(np.r_[starts, n]).max(initial=0))
    for lag in range(1, most):
        same = bucket[lag:] == bucket[:-lag]
        if cross is not None:
            same &= cross[lag:] != cross[:-lag]
        meets = np.zeros(plane.shape[1] * 64, np.uint8)
        meets[: n - lag] = same
        near = close_at_lag(plane, np.packbits(meets, bitorder="little").view(np.uint64), lag, radius)
        if len(near):
            out += forest.join(near, near + lag)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return values[pairs[:, 0]], values[pairs[:, 1]]


#: Rows of whole buckets compared together; one bucket, BUCKET rows or a tile of two, may be added to it.
TOGETHER = 1 << 15


def _compared(tiles: DataFrame, crossed: bool) -> DataFrame:
    """Links within the buckets of ``tiles`` (fp, bucket[, side])."""
    names = ["fp", "bucket", *(["side"] if crossed else [])]

    def solve(table: pa.Table) -> pa.RecordBatch:
        fp, bucket = table.column("fp").to_numpy(), table.column("bucket").to_numpy()
        u, v = linked(fp, bucket, table.column("side").to_numpy() if crossed else None)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                cut = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = tiles.select(*names).repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(released(run), "u long, v long")


def links(distinct: DataFrame, bucket_rows: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints ``fp`` within the radius of each other, directly or by steps.

    Counts of buckets decide which are parted again: the rows that meet are the same at every size.
    """
    parts = RADIUS + 1
    choices = [("", list(range(64)))]
    rows = distinct.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("bits"))
    out, written = [], []
    for level in range(depth):
        each = cut_lineage(_parted(rows, choices, parts))
        counts = each.groupBy("path", "bits").count().where("count > 1")
        large = cut_lineage(counts.where(F.col("count") > bucket_rows).select("path", "bits"))
        small = each.join(counts.where(F.col("count") <= bucket_rows).select("path", "bits"), ["path", "bits"])
        out.append(cut_lineage(_compared(small.withColumn("bucket", F.xxhash64("path", "bits")), False)))
        hot = cut_lineage(each.join(large, ["path", "bits"]))
        drop_cut(each)
        written += [large, hot]
        some = [r["path"] for r in large.select("path").distinct().collect()]  # at most parts ** level paths
        choices = [(path + str(i), [b for b in free if b not in block]) for path, free in choices for i, block in enumerate(_blocks(free, parts))]
        choices = [c for c in choices if c[0] in some]
        rows = hot
        if not choices:
            break
    else:
        sizes = rows.groupBy("path", "bits").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("tiles"))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        tiled = rows.join(sizes, ["path", "bits"]).withColumn("own", own)
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("fp", F.col("own").alias("side"), F.xxhash64("path", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), (F.col("own") == F.col("other")).alias("inner"))
        out.append(cut_lineage(_compared(tiled.where("inner"), False)))
        out.append(cut_lineage(_compared(tiled, True)))
    drop_cut(*written)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp, component): component is the smallest key reachable over links, the document's own included."""
    prints = cut_lineage(fingerprints(docs, key, text))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = links(nodes.select("fp"))
    roots = components(found)
    known = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(groups, "root").select("fp", "component")
    return prints.join(named, "fp").select(key, "fp", "component")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _with_prints(docs: DataFrame, out: str, text: str) -> DataFrame:
    """The rows with their fingerprint in a new column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = pa.array([fingerprint(x) for x in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=arrow)

    return docs.mapInArrow(released(run), schema)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """The documents that are the smallest key of their group; rows without a key stay.

    With ``repeats`` all rows of a kept key stay, and all rows of a key go that is not the smallest of a group. Without, rows that
    share a key are told apart by their groups, and one row of each group stays.
    """
    found = near_duplicates(docs, key, text)
    if repeats:
        extra = cut_lineage(found.where(F.col(key) != F.col("component")).select(key).distinct())
        return docs.join(marked(extra, extra.count() <= BROADCAST_KEYS), key, "left_anti")
    found = cut_lineage(found)
    several = cut_lineage(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    fits = several.count() <= BROADCAST_KEYS
    extra = cut_lineage(found.where(F.col(key) != F.col("component")).select(key).union(several).distinct())
    out = docs.join(marked(extra, extra.count() <= BROADCAST_KEYS), key, "left_anti").select(*docs.columns)
    if several.isEmpty():
        return out
    fp, name, group = (free_name(x, docs.columns) for x in ("_fp", "_of", "_group"))
    rows = _with_prints(docs.join(marked(several, fits), key, "left_semi").select(*docs.columns), fp, text)
    firsts = found.where(F.col(key) == F.col("component")).join(marked(several, fits), key, "left_semi").select(F.col("fp").alias(name), F.col("component").alias(group)).distinct()
    again = rows.join(firsts, (F.col(fp) == F.col(name)) & (F.col(key) == F.col(group))).dropDuplicates([group])
    return out.unionByName(again.select(*docs.columns))
