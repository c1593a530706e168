"""Duplicate and nearly equal lines by a segment-partition edit join.

Lines within ``EDITS`` edits (insert, delete, replace a character) of each other are linked. A line is cut into EDITS + 1 segments;
EDITS edits leave one of them whole, so the shorter line of a linked pair has a segment that is a substring of the longer one, near
its own place. Segments are hashed with the line's length and the segment's number, and the longer line probes the few substrings that
can align. Lines that share a key meet in one task; the parities of their character counts, 64 bits that one edit changes in two
places at most, leave few pairs, which are verified by a banded bit-parallel edit distance over many pairs at once.

Equal lines are one node of the join. A line's class is what it reaches over links, and the class stands for itself by its first
occurrence in the order of document and line.

Defined cases: null texts have no lines; lines without a word are neither compared nor removed; lines shorter than ``MIN_CHARS``
are linked to equal lines only; repeated documents repeat their lines; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut, marked
from cohortline.llm.common import free_name, released, sliced
from cohortline.llm.components import components
from cohortline.llm.simhash import _mask

#: Bytes of text whose equal lines become one before they leave a task.
SLICE = 4 << 20
EDITS = 2
#: Shorter lines have segments that say too little, and two edits would change what they say.
MIN_CHARS = 24
#: Lines that share a key and are compared at once; a key with more is dealt out in tiles of that size.
TOGETHER = 1024
#: One line in so many is looked at to find keys with too many lines before anything is dealt out by key.
SAMPLE = 64
#: Such keys, 8 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_LARGE = 500_000
#: Line ids, 16 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Removed lines, 4 bytes each and 50 for a document, whose numbers are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Characters of pairs that are verified together.
VERIFY_CHARS = 1 << 22
SPACE = " \t\n\x0b\x0c\r"
SEED = 42
#: The second hash of a line is chained behind this number.
SECOND = 7
SECOND_SEED = xxhash.xxh64_intdigest(SECOND.to_bytes(8, "little"), SEED)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line_no, line, a, b) of the lines that hold a word; (a, b) are 128 bits that stand for the line."""
    cut = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return cut.where(F.btrim("line", F.lit(SPACE)) != "").select(key, "line_no", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(SECOND).cast("long"), "line").alias("b"))


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line, the longer ones last."""
    count = edits + 1
    size, extra = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        n = size + (i >= count - extra)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int = EDITS, least: int = MIN_CHARS) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of the substrings that a line of ``length`` looks up.

    A start is tried only if the edits before the segment and those after it could both put it there.
    """
    out = []
    for short in range(max(least, length - edits), length + 1):
        gap = length - short
        for i, (at, n) in enumerate(segments(short, edits)):
            low = max(0, at - i, at + gap - (edits - i))
            high = min(length - n, at + i, at + gap + (edits - i))
            out += [(short, i, start, n) for start in range(low, high + 1)]
    return out


def _seed(length: int, segment: int) -> int:
    return length << 8 | segment


def parities(texts: list[str]) -> np.ndarray:
    """For each text 64 bits: whether the characters of a class, by code modulo 64, are odd in number."""
    if not texts:
        return np.zeros(0, np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    odd = np.bincount(row * 64 + codes % 64, minlength=64 * len(texts)).reshape(-1, 64) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0]


def _keys(docs: DataFrame, text: str, edits: int, least: int, sample: int = 1) -> DataFrame:
    """Rows (key, a, b, parity, probe), each line once for a slice of documents; of one line in ``sample``, by its hash."""
    plans: dict[int, tuple[list, list]] = {}

    def plan(n: int) -> tuple[list, list]:
        if n not in plans:
            if len(plans) > 20_000:
                plans.clear()
            plans[n] = ([(s, s + m, _seed(n, i)) for i, (s, m) in enumerate(segments(n, edits))], [(s, s + m, _seed(short, i)) for short, i, s, m in probes(n, edits, least)])
        return plans[n]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in sliced(batches, text, SLICE):
            found = list({x for whole in batch.column(text).to_pylist() if whole for x in whole.split("\n") if len(x) >= least and x.strip(SPACE)})
            if sample > 1:
                found = [x for x in found if digest(x.encode(), SEED) % sample == 0]
            keys, counts, first, second, indexed = [], [], [], [], []
            for line in found:
                own, others = plan(len(line))
                data = line if not line.isascii() else line.encode()
                keys += [digest(data[s:e], seed) for s, e, seed in own]
                keys += [digest(data[s:e], seed) for s, e, seed in others]
                counts.append(len(own) + len(others))
                indexed.append(len(own))
                whole = line.encode()
                first.append(digest(whole, SEED))
                second.append(digest(whole, SECOND_SEED))
            counts, indexed = np.array(counts, np.int64), np.array(indexed, np.int64)
            starts = np.cumsum(counts) - counts
            place = np.arange(int(counts.sum())) - np.repeat(starts, counts)
            columns = [
                np.array(keys, np.uint64).view(np.int64), np.repeat(np.array(first, np.uint64).view(np.int64), counts),
                np.repeat(np.array(second, np.uint64).view(np.int64), counts), np.repeat(parities(found), counts), place >= np.repeat(indexed, counts),
            ]
            for at in range(0, len(place), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 18)]) for c in columns], names=["key", "a", "b", "parity", "probe"])

    return docs.select(text).mapInArrow(released(run), "key long, a long, b long, parity long, probe boolean")


def _grouped(batches: Iterable[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted column; of a group with over ``most`` rows the first most + 1 and the last are enough."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column(column)[0].as_py() != batch.column(column)[batch.num_rows - 1].as_py():
            table = pa.Table.from_batches(held)
            value = table.column(column).to_numpy()
            cut = int(np.flatnonzero(value[1:] != value[:-1])[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
        elif most is not None and sum(x.num_rows for x in held) > most + 2:
            table = pa.Table.from_batches(held)
            held = pa.concat_tables([table.slice(0, most + 1), table.slice(table.num_rows - 1)]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _pairs(batches: Iterable[pa.RecordBatch], together: int, edits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each key whose parities allow the edits, or the key alone where it has too many lines for one task.

    Rows come sorted by key and probe, so that a key's first and last row tell whether it has both sides.
    """
    for table in _grouped(batches, "key", 2 * together):
        key, a, b, parity, probe = (table.column(c).to_numpy() for c in ("key", "a", "b", "parity", "probe"))
        parity = parity.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        mixed = np.minimum.reduceat(a, starts) != np.maximum.reduceat(a, starts)
        both = np.logical_or.reduceat(probe, starts) & ~np.logical_and.reduceat(probe, starts)
        found, hot = set(), []
        for s, e in zip(starts[mixed & both].tolist(), ends[mixed & both].tolist(), strict=True):
            if e - s > 2 * together:
                hot.append(int(key[s]))
                continue
            asks, own = s + np.flatnonzero(probe[s:e]), s + np.flatnonzero(~probe[s:e])
            near = np.bitwise_count(parity[asks][:, None] ^ parity[own][None, :]) <= 2 * edits
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                x, y = (int(a[asks[i]]), int(b[asks[i]])), (int(a[own[j]]), int(b[own[j]]))
                if x != y:
                    found.add((x, y) if x < y else (y, x))
        rows = [(*x, *y, None) for x, y in found] + [(None, None, None, None, k) for k in hot]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "c", "d", "hot"])


def within(first: list[str], second: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within the edits: bit-parallel columns of a band of 2 * edits + 1 rows, all pairs at once.

    Bit k of a column j stands for row j - edits + k. The distance is followed along the band's lowest diagonal and brought to the
    last row by the vertical differences; pairs leave as soon as it is out of reach.
    """
    count = len(first)
    out = np.zeros(count, bool)
    sizes = np.array([(len(x), len(y)) for x, y in zip(first, second, strict=True)], np.int64).reshape(-1, 2)
    order = np.argsort(-sizes[:, 1], kind="stable")
    order = order[np.abs(sizes[order, 0] - sizes[order, 1]) <= edits]
    done = 0
    while done < len(order):
        width = int(sizes[order[done], 1]) + 2 * edits + 1
        some = order[done:done + max(1, VERIFY_CHARS // width)]
        done += len(some)
        out[some] = _band([first[i] for i in some], [second[i] for i in some], sizes[some], edits)
    return out


def _codes(texts: list[str], width: int, before: int, filler: int) -> np.ndarray:
    codes = np.full((len(texts), width), filler, np.uint32)
    for i, x in enumerate(texts):
        codes[i, before:before + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes


def _band(first: list[str], second: list[str], sizes: np.ndarray, edits: int) -> np.ndarray:
    """As ``within`` for pairs in falling order of the second length."""
    out = np.zeros(len(first), bool)
    bits, one = 2 * edits + 1, np.uint64(1)
    full = np.uint64((1 << bits) - 1)
    longest = int(sizes[0, 1])
    rows = _codes(first, longest + bits + edits, edits, 1 << 30)  # row i stands at i - 1 + edits
    columns = _codes(second, longest, 0, 1 << 31)
    m, n, where = sizes[:, 0], sizes[:, 1], np.arange(len(first))
    up = np.full(len(first), int(full) & ~((1 << edits) - 1), np.uint64)  # rows below the first have a rising first column
    down = np.zeros(len(first), np.uint64)
    score = np.full(len(first), edits, np.int64)
    for j in range(longest + 1):
        ends = n == j
        if ends.any():
            for i in np.flatnonzero(ends).tolist():
                low, value = int(m[i] - n[i]) + edits, int(score[i])
                for k in range(low, 2 * edits):
                    value -= (int(up[i]) >> k & 1) - (int(down[i]) >> k & 1)
                out[where[i]] = value <= edits
        going = ~ends & (score <= 3 * edits) if j % 16 == 0 else ~ends
        if not going.all():
            rows, columns, m, n, where, up, down, score = (x[going] for x in (rows, columns, m, n, where, up, down, score))
        if not len(where):
            break
        same = np.zeros(len(where), np.uint64)
        for k in range(bits):
            same |= (rows[:, j + k] == columns[:, j]).astype(np.uint64) << np.uint64(k)
        zero = ((((same & up) + up) ^ up) | same | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        score += 1 - (zero >> np.uint64(2 * edits) & one).astype(np.int64)
        up = (minus | ~(zero >> one | plus)) & full
        down = zero >> one & plus
    return out


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """One row (a, b, line) for each wanted line."""
    ids = cut_lineage(wanted)
    found = lines(docs, key, text).select("a", "b", "line").join(marked(ids, ids.count() <= BROADCAST_IDS), ["a", "b"])
    table = cut_lineage(found.groupBy("a", "b").agg(F.first("line").alias("line")))
    drop_cut(ids)
    return table


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(sliced(batches, "x"), "y"):
            near = within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), edits)
            yield batch.select(["a", "b", "c", "d"]).filter(pa.array(near))

    return pairs.select("a", "b", "c", "d", "x", "y").mapInArrow(released(run), "a long, b long, c long, d long")


def _dealt(keys: DataFrame) -> DataFrame:
    return keys.repartition("key").dropDuplicates(["key", "a", "b", "probe"]).sortWithinPartitions("key", "probe")


def _compared(dealt: DataFrame, together: int, edits: int) -> DataFrame:
    return cut_lineage(dealt.mapInArrow(released(lambda batches: _pairs(batches, together, edits)), "a long, b long, c long, d long, hot long"))


def _large(docs: DataFrame, text: str, edits: int, least: int, together: int, sample: int = SAMPLE) -> DataFrame:
    """Rows (hot) of the keys that a sample of the lines shows to be too large for one task. A written table.

    Only the way of a key depends on it, not its links: a large key that the sample misses is found where its rows meet.
    """
    some = _keys(docs, text, edits, least, sample).select("key", "a", "b", "probe").distinct()
    return cut_lineage(some.groupBy(F.col("key").alias("hot")).count().where(F.col("count") > max(1, 2 * together // sample)).select("hot"))


def _parted(rows: DataFrame, edits: int) -> DataFrame:
    """Each row once for every block of its parities: lines within the edits differ in 2 * edits of the bits and agree in a block."""
    count = 2 * edits + 1
    blocks = [F.xxhash64("key", F.lit(i), F.col("parity").bitwiseAND(F.lit(_mask(list(range(i, 64, count)))).cast("long"))) for i in range(count)]
    return rows.select(F.explode(F.array(*blocks)).alias("key"), "a", "b", "parity", "probe")


def _tiled(keys: DataFrame, hot: DataFrame, docs: DataFrame, key: str, text: str, together: int, edits: int) -> DataFrame:
    """Links among the lines of keys with very many lines, parted by parities and, where that is not enough, dealt out in tiles
    of index and probe lines, which are compared where they meet."""
    found = cut_lineage(keys.join(marked(hot, hot.count() <= BROADCAST_LARGE), keys["key"] == hot["hot"], "left_semi").select("key", "a", "b", "parity", "probe").distinct())
    known = _texts(docs, found.select("a", "b").distinct(), key, text)
    rows = _parted(found, edits)
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / together).cast("int").alias("tiles"), F.bool_or("probe").alias("asks"), F.bool_or(~F.col("probe")).alias("own")).where("asks and own").select("key", "tiles")
    tiled = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    row, column = F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")), F.when(F.col("probe"), F.col("other")).otherwise(F.col("own"))
    dealt = tiled.withColumn("tile", F.xxhash64("key", row, column)).join(known, ["a", "b"]).select("tile", "a", "b", "parity", "probe", "line")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "tile"):
            tile, a, b, parity, probe = (table.column(c).to_numpy() for c in ("tile", "a", "b", "parity", "probe"))
            parity, line = parity.view(np.uint64), np.array(table.column("line").to_pylist(), object)
            size = np.fromiter(map(len, line), np.int64, len(line))
            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=True):
                own, every = s + np.flatnonzero(~probe[s:e]), s + np.flatnonzero(probe[s:e])
                for at in range(0, len(every), 256):
                    asks = every[at:at + 256]
                    gap = size[asks][:, None] - size[own][None, :]
                    near = (np.bitwise_count(parity[asks][:, None] ^ parity[own][None, :]) <= 2 * edits) & (gap >= 0) & (gap <= edits)
                    near &= (a[asks][:, None] != a[own][None, :]) | (b[asks][:, None] != b[own][None, :])
                    i, j = np.nonzero(near)
                    i, j = asks[i], own[j]
                    linked = within(line[j].tolist(), line[i].tolist(), edits)
                    i, j = i[linked], j[linked]
                    first = (a[i] < a[j]) | ((a[i] == a[j]) & (b[i] < b[j]))
                    x, y = np.where(first, i, j), np.where(first, j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[x], b[x], a[y], b[y])], names=["a", "b", "c", "d"])

    links = cut_lineage(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(released(run), "a long, b long, c long, d long"))
    drop_cut(found, known)
    return links


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = MIN_CHARS, together: int = TOGETHER) -> DataFrame:
    """Distinct links (a, b, c, d) between different lines within the edits, the smaller (a, b) first. A written table."""
    if least < edits + 1:
        raise ValueError("lines must be long enough for edits + 1 segments")
    keys = _keys(docs, text, edits, least)
    large = _large(docs, text, edits, least, together)
    rest = keys.join(marked(large, large.count() <= BROADCAST_LARGE), keys["key"] == large["hot"], "left_anti")
    found = _compared(_dealt(rest), together, edits)
    hot = cut_lineage(found.where("hot is not null").select("hot").union(large).distinct())
    pairs = found.where("hot is null").select("a", "b", "c", "d").distinct()
    known = _texts(docs, pairs.select("a", "b").union(pairs.select("c", "d")).distinct(), key, text)
    left = known.select("a", "b", F.col("line").alias("x"))
    right = known.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("line").alias("y"))
    near = _verified(pairs.join(left, ["a", "b"]).join(right, ["c", "d"]), edits)
    if not hot.isEmpty():
        more = _tiled(keys, hot, docs, key, text, together, edits)
        out = cut_lineage(near.union(more).distinct())
        drop_cut(more)
    else:
        out = cut_lineage(near)
    drop_cut(found, known, large, hot)
    return out


def _name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _classes(docs: DataFrame, key: str, text: str, edits: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``classes`` and the written tables they are read from."""
    first, number = free_name("class_key", [key]), "class_line"
    every = cut_lineage(lines(docs, key, text).drop("line"))
    joined = links(docs, key, text, edits, least)
    sides = joined.select("a", "b").union(joined.select(F.col("c").alias("a"), F.col("d").alias("b")))
    degree = sides.groupBy("a", "b").agg(F.count("*").alias("n_links"))
    roots = components(joined.select(_name("a", "b").alias("u"), _name("c", "d").alias("v")))
    nodes = cut_lineage(degree.join(roots, _name("a", "b") == F.col("node")).select("a", "b", "n_links", "root"))
    drop_cut(joined, roots)
    distinct = every.groupBy("a", "b").agg(F.min(F.struct(key, "line_no")).alias("_first"))
    known = distinct.join(nodes, ["a", "b"], "left")
    leads = known.where("root is not null").groupBy("root").agg(F.min("_first").alias("_lead"))
    lead = known.join(leads, "root", "left").select("a", "b", F.coalesce("_lead", "_first").alias("_lead"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = every.join(lead, ["a", "b"]).select(
        key, F.col("line_no").cast("long").alias("line_no"), F.col(f"_lead.{key}").alias(first), F.col("_lead.line_no").cast("long").alias(number),
        "n_links", (F.struct(key, "line_no") == F.col("_lead")).alias("kept"),
    )
    return found, [every, nodes]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """Rows (key, line_no, class_key, class_line, n_links, kept) for every line that holds a word.

    (class_key, class_line) is the first occurrence in the line's class, which alone is kept; n_links counts the different lines
    that the line is linked to directly.
    """
    return _classes(docs, key, text, edits, least)[0]


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = MIN_CHARS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The documents with only the first line of each class; lines without a word stay. A document may become empty."""
    found, tables = _classes(docs, key, text, edits, least)
    out, name, parts = (free_name(x, docs.columns) for x in ("_gone", "_key", "_lines"))
    gone = cut_lineage(found.where(~F.col("kept")).select(F.col(key).alias(name), F.col("line_no").cast("int").alias("n")))
    drop_cut(*tables)
    lists = gone.groupBy(name).agg(F.collect_set("n").alias(out))
    source = docs.join(marked(lists, gone.count() <= broadcast_lines), F.col(key) == F.col(name), "left")
    cut = source.withColumn(parts, F.when(F.col(out).isNotNull(), F.split(F.col(text), "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(out))
    joined = F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")
    return cut.withColumn(text, F.when(F.col(out).isNull(), F.col(text)).otherwise(joined)).select(*docs.columns)
