"""Exact top-k by inner product with M-trees.

Vectors become integers. One more coordinate, sqrt(M - |x|^2) with M the largest squared length, puts all of them on a sphere, so
that the largest inner product is the smallest distance and the triangle inequality holds. Pivots from a bounded sample part
the vectors into regions with covering radii; a region is dealt out in shares, and each share is an M-tree of pages: entries
with routing vectors, covering radii and distances to the page's own routing vector. The pages are a table in the shared folder.

A query first searches one share of its nearest region, which bounds its k-th score, and then every share of the regions that
the bound cannot exclude. Inside a tree pages are taken best first; an entry whose distance to its parent already excludes it is
never compared. Queries go in blocks, so a task holds one share and one block.

Vectors whose products could leave a long are in no tree: they meet all queries, and as queries all rows, with exact scores of
any size, in blocks.

Defined cases: null ids, null vectors and those with null or non-finite components take no part; a score beyond a long counts as
the nearest long; repeated rows count once; vectors meet only vectors of their length; equal vectors are one entry with their
smallest ids, as many as a result can hold; an id with several vectors is a row for each, never its own result, and as a query has
the best of all; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut
from cohortline.llm.hard_negatives import best_rows

SCALE = 1024
#: What the length of a vector times its largest squared component must stay below to be put into a tree.
ROOM = float(1 << 60)
#: Pivots at most: the sample of vectors that parts the rest into regions, in hash order.
PIVOTS = 256
#: Vectors of one tree, about, and queries of one block.
TREE_ROWS = 16_384
BLOCK_QUERIES = 1024
LEAF, FAN = 160, 32
PAGE = "page int, leaf boolean, vectors binary, radii binary, to_parent binary, children binary, ids binary, n_ids binary"
NOTHING = np.iinfo(np.int64).min


def taking_part(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct rows (vec_id, d, dim, fits): the components as doubles, and whether sums of their products stay well inside a long."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("d")).distinct()
    largest = F.coalesce(F.array_max(F.transform("d", F.abs)), F.lit(0.0)) * SCALE + 1
    return rows.withColumn("dim", F.size("d")).withColumn("fits", F.col("dim") * largest * largest < ROOM)


def integers(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v, dim) of those that fit; v has floor(1024 * x) of each component."""
    some = rows.where("fits").select("vec_id", F.transform("d", lambda x: F.floor(x * SCALE).cast("long")).alias("v"), "dim")
    return some.distinct()


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros((0, 0), np.int64)


class Sphere:
    """Distances between integer vectors lifted to squared length ``top``; a query has nothing in the last coordinate."""

    def __init__(self, top: int):
        self.top = top

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (self.top - (x * x).sum(axis=1)).astype(np.float64)))

    def among(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all x to all y."""
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        flat = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
        lifted = self.lift(x)[:, None] - self.lift(y)[None, :]
        return np.sqrt(np.maximum(0.0, flat + lifted * lifted))

    def of_scores(self, length: int, scores: np.ndarray) -> np.ndarray:
        """Distances of a query of squared length ``length`` to vectors with these inner products."""
        return np.sqrt(np.maximum(0.0, (length + self.top - 2 * scores).astype(np.float64)))


def build(vectors: np.ndarray, ids: list[np.ndarray], sphere: Sphere) -> list[tuple]:
    """Pages of one M-tree over distinct vectors; page 0 is the root."""
    pages: list = []

    def page(rows: np.ndarray, parent: np.ndarray | None) -> int:
        number = len(pages)
        pages.append(None)
        if len(rows) <= LEAF:
            own = vectors[rows]
            near = sphere.among(own, parent[None])[:, 0] if parent is not None else np.zeros(len(rows))
            flat = np.concatenate([ids[r] for r in rows]) if len(rows) else np.zeros(0, np.int64)
            pages[number] = (number, True, own.tobytes(), b"", near.tobytes(), b"", flat.tobytes(), np.array([len(ids[r]) for r in rows], np.int32).tobytes())
            return number
        count = min(FAN, -(-len(rows) // LEAF))
        heads = rows[np.linspace(0, len(rows) - 1, count).astype(np.int64)]
        far = sphere.among(vectors[rows], vectors[heads])
        nearest = far.argmin(axis=1)
        if np.bincount(nearest, minlength=count).max() == len(rows):  # heads do not tell the rows apart
            nearest = np.arange(len(rows)) % count
        radii, children, used = [], [], []
        for h in range(count):
            own = np.flatnonzero(nearest == h)
            if len(own):
                radii.append(far[own, h].max())
                used.append(heads[h])
                children.append(page(rows[own], vectors[heads[h]]))
        routing = vectors[used]
        near = sphere.among(routing, parent[None])[:, 0] if parent is not None else np.zeros(len(used))
        pages[number] = (number, False, routing.tobytes(), np.array(radii).tobytes(), near.tobytes(), np.array(children, np.int32).tobytes(), b"", b"")
        return number

    page(np.arange(len(vectors)), None)
    return pages


class Tree:
    """One M-tree read from its pages.

    Inner products are at most the largest squared length; below 2 ** 52 they are whole numbers in doubles too, which multiply faster.
    """

    def __init__(self, pages: pd.DataFrame, dim: int, sphere: Sphere):
        self.sphere, self.pages = sphere, {}
        self.kind = np.float64 if sphere.top < 1 << 52 else np.int64
        for p in pages.itertuples(index=False):
            n = len(p.to_parent) // 8
            self.pages[p.page] = (
                p.leaf, np.frombuffer(p.vectors, np.int64).reshape(n, dim).astype(self.kind), np.frombuffer(p.radii), np.frombuffer(p.to_parent),
                np.frombuffer(p.children, np.int32), np.frombuffer(p.ids, np.int64), np.cumsum(np.r_[0, np.frombuffer(p.n_ids, np.int32)]),
            )

    def search(self, query: np.ndarray, own: int, k: int, bound: int) -> list[tuple[int, int]]:
        """At most k pairs (score, id), best first; nothing below ``bound`` is looked for. Equal scores: the smaller id."""
        length = int(query @ query)
        query = query.astype(self.kind)
        best: list[tuple[int, int]] = []  # a heap, the worst first

        def reach() -> float:
            """The distance beyond which nothing can enter, with room for rounding."""
            worst = max(bound, best[0][0]) if len(best) == k else bound
            if worst == NOTHING:
                return np.inf
            d = float(np.sqrt(max(0.0, float(length + self.sphere.top - 2 * worst))))
            return d + 1e-7 * (d + 1)

        queue = [(0.0, 0, np.nan)]
        while queue:
            least, number, to_parent = heapq.heappop(queue)
            limit = reach()
            if least > limit:
                break
            leaf, vectors, radii, near, children, ids, ends = self.pages[number]
            slack = 1e-9 * (near + 1)
            if np.isnan(to_parent):
                rows = np.arange(len(near))
            else:
                gap = np.abs(to_parent - near) - (0 if leaf else radii) - slack
                rows = np.flatnonzero(gap <= limit)
            scores = ((vectors if len(rows) == len(near) else vectors[rows]) @ query).astype(np.int64)
            if leaf:
                worst = max(bound, best[0][0]) if len(best) == k else bound
                some = np.flatnonzero(scores >= worst)
                some = some[np.argsort(-scores[some], kind="stable")]
                for r, s in zip(rows[some].tolist(), scores[some].tolist(), strict=True):
                    if len(best) == k and s < best[0][0]:
                        break
                    for i in ids[ends[r]:ends[r + 1]].tolist():
                        if i == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                        else:
                            break
            else:
                far = self.sphere.of_scores(length, scores)
                low = np.maximum(0.0, far - radii[rows])
                for at in np.flatnonzero(low <= limit).tolist():
                    heapq.heappush(queue, (float(low[at]), int(children[rows[at]]), float(far[at])))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _regions(rows: DataFrame, pivots: dict[int, np.ndarray], sphere: Sphere) -> DataFrame:
    """The rows with their nearest pivot of the same length and the distance to it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                far = sphere.among(_matrix(part["v"]), pivots[dim])
                yield part.assign(region=far.argmin(axis=1).astype(np.int32), far=far.min(axis=1))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{names}, region int, far double")


def top_k(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest inner products of each query with every other row.

    ``is_query`` is a condition on ``vec_id``.
    """
    every = cut_lineage(taking_part(table, key, vector))
    found = _top_of_trees(integers(every), is_query, k)
    as_rows = lambda df: df.select(F.col("vec_id").alias("id"), F.col("d").alias("v"))
    wide = every.where(~F.col("fits"))
    if not wide.isEmpty():
        asked = every.where(is_query)
        more = best_rows(as_rows(wide), as_rows(asked.where("fits")), k, SCALE).union(best_rows(as_rows(every), as_rows(asked.where(~F.col("fits"))), k, SCALE))
        found = found.union(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _top_of_trees(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score) that hold the k best of each query among the rows in trees."""
    rows = cut_lineage(rows)
    copies = rows.withColumn("_n", F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    entries = cut_lineage(copies.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    squared = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    of_dims = entries.groupBy("dim").agg(F.count("*").alias("n"), F.max(squared).alias("top"))
    total, top = of_dims.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("top"), F.lit(0))).first()
    sphere = Sphere(int(top))
    each = max(1, min(PIVOTS, -(-total // TREE_ROWS)))
    order = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v")
    sample = entries.select("dim", "v", F.row_number().over(order).alias("n")).where(F.col("n") <= each).orderBy("dim", "n").collect()
    pivots = {d: _matrix([r["v"] for r in sample if r["dim"] == d]) for d in {r["dim"] for r in sample}}
    placed = cut_lineage(_regions(entries, pivots, sphere))
    sizes = cut_lineage(placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("shares"), F.max("far").alias("radius")))
    region = {(r["dim"], r["region"]): (r["shares"], r["radius"]) for r in sizes.collect()}  # PIVOTS rows for each length

    shared = placed.join(F.broadcast(sizes), ["dim", "region"]).withColumn("share", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int"))

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        found = build(_matrix(frame["v"]), [np.asarray(x, np.int64) for x in frame["ids"]], sphere)
        out = pd.DataFrame(found, columns=["page", "leaf", "vectors", "radii", "to_parent", "children", "ids", "n_ids"])
        return out.assign(dim=frame["dim"].iloc[0], region=frame["region"].iloc[0], share=frame["share"].iloc[0])

    pages = cut_lineage(shared.select("dim", "region", "share", "v", "ids").groupBy("dim", "region", "share").applyInPandas(built, f"{PAGE}, dim int, region int, share int"))
    asked_table = cut_lineage(_regions(rows.where(is_query), pivots, sphere).select("vec_id", "v", "dim", "region"))
    blocks = max(1, -(-asked_table.count() // BLOCK_QUERIES))
    asked = asked_table.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def searched(where: DataFrame) -> DataFrame:
        keys = ["dim", "region", "share", "block"]
        wanted = where.select(*keys).distinct().toDF("_dim", "_region", "_share", "_block")
        same = (F.col("dim") == F.col("_dim")) & (F.col("region") == F.col("_region")) & (F.col("share") == F.col("_share"))
        dealt = pages.join(wanted, same).select(*pages.columns, F.col("_block").alias("block"))

        def run(key_: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(tree) and len(queries):
                own = Tree(tree, int(key_[0]), sphere)
                for q in queries.itertuples(index=False):
                    found = own.search(np.asarray(q.v, np.int64), q.vec_id, k, q.bound)
                    out += [(q.vec_id, i, s) for s, i in found]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

        return dealt.groupBy(*keys).cogroup(where.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    shares = F.broadcast(sizes.select("dim", "region", "shares"))
    home = asked.join(shares, ["dim", "region"]).withColumn("share", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int"))
    first = searched(home.select("vec_id", "v", "dim", "region", "share", "block", F.lit(NOTHING).alias("bound")))
    ranked = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
    bounds = cut_lineage(ranked.select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound")))

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every share of a region that its bound does not exclude."""
        for frame in frames:
            out = []
            for q in frame.itertuples(index=False):
                v = np.asarray(q.v, np.int64)
                length = int(v @ v)
                far = sphere.of_scores(length, pivots[q.dim] @ v)
                reach = np.inf if q.bound == NOTHING else float(np.sqrt(max(0.0, float(length + sphere.top - 2 * q.bound))))
                for r, d in enumerate(far.tolist()):
                    if (q.dim, r) in region:
                        count, radius = region[q.dim, r]
                        if d - radius <= reach + 1e-7 * (reach + d + 1 if reach < np.inf else 1):
                            out += [(q.vec_id, q.v, q.dim, r, s, q.block, q.bound) for s in range(count)]
            yield pd.DataFrame(out, columns=["vec_id", "v", "dim", "region", "share", "block", "bound"])

    known = asked.join(bounds, "vec_id", "left").select("vec_id", "v", "dim", "block", F.coalesce("bound", F.lit(NOTHING)).alias("bound"))
    where = cut_lineage(known.mapInPandas(reached, "vec_id long, v array<long>, dim int, region int, share int, block int, bound long"))
    found = cut_lineage(searched(where))
    drop_cut(rows, entries, placed, sizes, pages, asked_table, bounds, where)
    return found
