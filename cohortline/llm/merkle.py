"""Merkle manifest of a table, with a witness for every row.

Rows become leaves; the leaves of a tree (a source) stand in the order of their keys. While several nodes remain, every RUN
consecutive ones become their hash. The roots of the trees, in the order of the trees' names, are the leaves of one more tree.

Nodes are appended one after another to the open subtrees of an aligned block of ``RUN ** BLOCK_LEVELS`` places. A subtree holds the
partial witnesses of the leaves below it; when its last sibling is complete, they are extended and the subtree is appended one
level higher. Blocks are appended to by different tasks, and their roots are further appends: to blocks of block roots, until one
root is left for each tree. On the way back each block hands the steps above its root to the leaves below it.

Places come from one sort by ranges and the counts of its partitions, so a tree that owns a third of all rows lies over many
tasks; no task holds more than one block, and the driver holds one number, the size of the largest tree.

Defined cases: a null field is written as ``-``; null trees are one tree before all others, and null keys come first in theirs;
equal keys are ordered by their leaves, and repeated rows are leaves each; an empty table has no rows; columns of other names
are not read, kept columns that are named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut, marked
from cohortline.llm.common import arrow_schema

RUN = 16
#: Levels of a block; RUN ** BLOCK_LEVELS nodes at most meet in one task.
BLOCK_LEVELS = 3
#: Rows of (tree, partition), about 60 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 500_000
#: Characters of a digest.
WIDTH = 64
STEPS = "array<struct<left: string, right: string>>"
OUTPUTS = ("leaf", "subroot", "root", "witness")


def digest(*texts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts one after another."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of fields in order: the UTF-8 byte count, a colon and the value, or ``-`` for a null."""
    texts = [x.cast("string") for x in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


class Block:
    """Open subtrees of one aligned block, and a witness for each node appended to it."""

    def __init__(self, levels: int, run: int = RUN):
        self.levels, self.run, self.root = levels, run, None
        self.open: list[list[tuple[str, range]]] = [[] for _ in range(levels)]
        #: For each node the texts of its left and right siblings, level by level.
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._complete(0, node, range(at, at + 1))

    def _complete(self, level: int, node: str, below: range) -> None:
        """A subtree is complete: it joins its open run, which closes when it is full."""
        if level == self.levels:
            self.root = node
            return
        self.open[level].append((node, below))
        if len(self.open[level]) == self.run:
            self._close(level)

    def _close(self, level: int) -> None:
        siblings, self.open[level] = self.open[level], []
        text = "".join([node for node, _ in siblings])
        for i, (_, below) in enumerate(siblings):
            step = text[:WIDTH * i], text[WIDTH * (i + 1):]
            for at in below:
                self.witness[at].append(step)
        whole = range(siblings[0][1].start, siblings[-1][1].stop)
        self._complete(level + 1, sha256(text.encode()).hexdigest(), whole)

    def finish(self) -> str | None:
        """Close what is still open, lowest level first; the root of the block."""
        for level, run in enumerate(self.open):
            if run:
                self._close(level)
        return self.root


def _filled(nodes: pa.Table) -> tuple[pa.Table, Block]:
    nodes = nodes.sort_by("pos")
    block = Block(nodes.column("levels")[0].as_py())
    for node in nodes.column("node").to_pylist():
        block.append(node)
    block.finish()
    return nodes, block


def _depth(size: Column) -> Column:
    """Levels of a tree of so many nodes."""
    steps, power = F.lit(0), 1
    while power < 1 << 62:
        steps, power = steps + (size > power).cast("int"), power * RUN
    return steps


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes (t, key, node, row, kept) with their place ``pos`` in tree t, and its ``size``; rows are told apart by ``row``."""
    order = ["t", "key", "node", "row"]
    by_range = cut_lineage(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = by_range.groupBy("t", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("t")
    before = F.sum("n").over(tree.orderBy("part")) - F.col("n")
    runs = cut_lineage(runs.select("t", "part", F.col("first") - before, F.sum("n").over(tree)).toDF("t", "part", "shift", "size"))
    joined = by_range.withColumn("part", part).join(marked(runs, runs.count() <= BROADCAST_PARTS), ["t", "part"])
    out = cut_lineage(joined.select("t", (F.col("at") - F.col("shift")).alias("pos"), "size", "node", "kept"))
    drop_cut(by_range, runs)
    return out


def _in_blocks(nodes: DataFrame) -> DataFrame:
    span = RUN ** BLOCK_LEVELS
    levels = F.least(F.lit(BLOCK_LEVELS), _depth(F.col("size")))
    return nodes.withColumns({"block": F.floor(F.col("pos") / span), "levels": levels})


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks, as nodes of the next stage."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, block = _filled(group)
        size = -(-group.column("size")[0].as_py() // RUN ** BLOCK_LEVELS)
        return pa.table({"t": [key[0].as_py()], "pos": [key[1].as_py()], "size": [size], "node": [block.root]})

    own = _in_blocks(nodes).select("t", "block", "pos", "size", "levels", "node")
    return own.groupBy("t", "block").applyInArrow(run, "t string, pos long, size long, node string")


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their block roots, the roots of these in blocks, and so on to one root for each tree."""
    stages = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        stages.append(cut_lineage(_roots(stages[-1])))
        largest = -(-largest // RUN ** BLOCK_LEVELS)
        if largest <= 1:
            return stages


def _extending(arrow: pa.Schema):
    """Witnesses of a block's nodes, extended by the steps above its root."""
    def run(group: pa.Table, upper: pa.Table) -> pa.Table:
        group, block = _filled(group)
        rest = [(s["left"], s["right"]) for s in upper.column("steps")[0].as_py()]
        lists = [steps + rest for steps in block.witness]
        ends = [0]
        for steps in lists:
            ends.append(ends[-1] + len(steps))
        flat = pa.StructArray.from_arrays([pa.array([s[i] for steps in lists for s in steps], pa.string()) for i in (0, 1)], ["left", "right"])
        new = {"steps": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}
        for name in ("subroot", "root"):
            new[name] = pa.array([upper.column(name)[0].as_py()] * group.num_rows, pa.string())
        return pa.table([new[f.name].cast(f.type) if f.name in new else group.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return run


def _witnessed(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the first stage with the steps to the root; ``tops`` (t, pos, steps, subroot, root) has those above each tree."""
    above = tops
    for level in range(len(stages) - 2, -1, -1):
        nodes = _in_blocks(stages[level])
        kept = [f for f in ("kept",) if f in nodes.columns]
        nodes = nodes.select("t", "block", "pos", "levels", "node", *kept)
        schema = nodes.select("t", "pos", "node", *kept, F.lit(None).cast(STEPS).alias("steps"), F.lit("").alias("subroot"), F.lit("").alias("root")).schema
        above = above.select("t", F.col("pos").alias("block"), "steps", "subroot", "root")
        both = nodes.groupBy("t", "block").cogroup(above.groupBy("t", "block"))
        above = both.applyInArrow(_extending(arrow_schema(schema)), schema)
    return above


def manifest(docs: DataFrame, fields: Sequence[str], tree: str = "source", order: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (order, keep..., leaf, subroot, root, witness) for the rows of ``docs``.

    ``witness`` has for each level, from the leaf to the root of all trees, the digests left and right of the path as text:
    ``folded`` gives the root again from a leaf and its witness. ``keep`` may hold small columns only, since they are moved
    with the leaves.
    """
    t = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    kept = F.struct(order, *[c for c in keep if c != order and c.lower() not in OUTPUTS])
    # Texts are read once; the sort that follows samples these rows, not the texts.
    leaves = cut_lineage(docs.select(
        t.alias("t"), F.col(order).alias("key"), leaf(*[F.col(c) for c in fields]).alias("node"), kept.alias("kept"),
    ).withColumn("row", F.monotonically_increasing_id()))
    nodes = _placed(leaves)
    stages = _stages(nodes)
    of_trees = stages[-1].select(F.lit("").alias("t"), F.col("t").alias("key"), "node", F.lit(0).cast("long").alias("row"), F.struct("t").alias("kept"))
    top_stages = _stages(_placed(of_trees))
    nothing = F.array().cast(STEPS)
    top = top_stages[-1].select("t", "pos", nothing.alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = cut_lineage(_witnessed(top_stages, top).select("kept.t", F.lit(0).cast("long").alias("pos"), "steps", F.col("node").alias("subroot"), "root"))
    drop_cut(leaves, *top_stages)
    return _witnessed(stages, tops).select("kept.*", F.col("node").alias("leaf"), "subroot", "root", F.col("steps").alias("witness"))


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf digest and its witness give."""
    return F.aggregate(witness, start, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(witness: Column) -> Column:
    """All digests of a witness as one text, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda step: F.concat(step["left"], step["right"])), "")
