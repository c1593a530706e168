"""Harmonic packing of token sequences into rows of fixed capacity.

Piece lengths fall into reciprocal classes: class k holds lengths in (capacity / (k + 1), capacity / k], so any k of its pieces
fill one sequence. Each worker fills the sequences of its own share of a class with k pieces each and passes on fewer than k,
which fewer workers join in the next round. No worker needs to know what another one holds. What the last round leaves over,
less than one sequence for each class, is put together by decreasing length.

Documents may be cut anywhere. A document gives whole sequences first; its rest is cut by a small table that weighs the
padding of each class against a cost for every further piece.

Defined cases: a null text counts as empty and an empty document is its end token alone; repeated rows are packed each; ``cut``
reads the key and the text only; ``place`` keeps all columns of the pieces, and those named as an output are replaced; an empty
table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.sizing import cut_lineage, drop_cut
from cohortline.llm.byte_tokens import coder
from cohortline.llm.common import arrow_schema, free_name, released, sliced

CAPACITY = 1024
END = 0
#: Tokens of padding that one piece less is worth.
PIECE_COST = 2.0
#: Pieces that one worker's share of a class has in the first round, on average over classes.
SHARE = 1 << 14
#: Shares that meet in one in the next round.
FOLD = 32


@cache
def cuts(capacity: int, piece_cost: float = PIECE_COST) -> list[tuple[int, ...]]:
    """For each rest below the capacity, the lengths it is cut into."""
    sizes = sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)
    cost, plan = [0.0], [()]
    for rest in range(1, capacity):
        best, lengths = capacity / (capacity // rest) - rest + piece_cost, (rest,)
        for size in sizes:
            if size < rest:
                value = capacity / (capacity // size) - size + piece_cost + cost[rest - size]
                if value < best - 1e-9:
                    best, lengths = value, (size, *plan[rest - size])
        cost.append(best)
        plan.append(lengths)
    return plan


def first_fit(sizes: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """For each class left over, a sequence and the offset there: largest first, into the first that has room."""
    used, out = [], {}
    for k, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = next((i for i, n in enumerate(used) if n + size <= capacity), len(used))
        if at == len(used):
            used.append(0)
        out[k] = (at, used[at])
        used[at] += size
    return out


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, doc_tokens, ids) of the documents' tokens, an end token after each document.

    ``ids`` are little-endian 32-bit numbers.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
        T.StructField("doc_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False),
    ])
    arrow, end = arrow_schema(schema), np.array([END], "<i4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, encoder = cuts(capacity), coder(path)
        for batch in sliced(batches, text):
            row, start, length, tokens, ids = [], [], [], [], []
            for i, data in enumerate(encoder.encode(batch.column(text).to_pylist())):
                data += end
                n, at = len(data) // 4, 0
                for size in (*[capacity] * (n // capacity), *plan[n % capacity]):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    tokens.append(n)
                    ids.append(data[4 * at:4 * (at + size)])
                    at += size
            columns = [batch.column(key).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(key, text).mapInArrow(released(run), schema)


def place(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", share: int = SHARE, fold: int = FOLD) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: k pieces of class k in each sequence, one after another.

    Shares are chosen by a hash, so that copies of a document and pieces of a long one lie apart.
    """
    given = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    k_, share_, n_, rank_, bin_ = (free_name(x, given) for x in ("_k", "_share", "_n", "_rank", "_bin"))
    table = cut_lineage(pieces.select(*given).withColumn(k_, F.floor(F.lit(capacity) / F.col("length")).cast("long")))
    shares = max(1, -(-table.count() // share))
    room = (1 << 62) // (64 * (capacity + 1) * shares)
    if room < 1 << 20:
        raise ValueError("too many shares for one 64-bit sequence number")
    left, placed, level = table, [], 0
    while True:
        share_of = F.pmod(F.xxhash64(key, "start", F.lit(level)), F.lit(shares))
        group = Window.partitionBy(k_, share_)
        ranked = (
            left.withColumn(share_, share_of)
            .withColumn(n_, F.count("*").over(group))
            .withColumn(rank_, F.row_number().over(group.orderBy("length", key, "start")) - 1)
        )
        ranked = cut_lineage(ranked)
        drop_cut(left)
        full = F.col(rank_) < F.col(n_) - F.col(n_) % F.col(k_)
        number = F.floor(F.col(rank_) / F.col(k_))
        first = (F.lit(level * (capacity + 1)) + F.col(k_)) * F.lit(shares) + F.col(share_)
        within = Window.partitionBy(k_, share_, bin_).orderBy(rank_)
        done = ranked.where(full).withColumn(bin_, number)
        placed.append(done.select(
            *given, (first * F.lit(room) + F.col(bin_)).cast("long").alias("sequence_id"),
            (F.sum("length").over(within) - F.col("length")).cast("long").alias("offset"),
        ))
        if shares == 1:
            rest = ranked.where(~full)
            sizes = {r[k_]: r["n"] for r in rest.groupBy(k_).agg(F.sum("length").alias("n")).collect()}  # a row for each class
            places = F.create_map(*[F.lit(x).cast("long") for k, (at, base) in first_fit(sizes, capacity).items() for x in (k, at * capacity + base)] or [F.lit(0).cast("long")] * 2)
            at = F.element_at(places, F.col(k_))
            own = F.sum("length").over(Window.partitionBy(k_).orderBy(rank_)) - F.col("length")
            placed.append(rest.select(
                *given, (F.lit((level + 1) * (capacity + 1) * room) + F.floor(at / capacity)).cast("long").alias("sequence_id"),
                (at % capacity + own).cast("long").alias("offset"),
            ))
            break
        left = cut_lineage(ranked.where(~full).select(*given, k_))
        shares, level = -(-shares // fold), level + 1
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    return place(cut(docs, path, capacity, key, text), capacity, key)
