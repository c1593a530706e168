"""Connected components of an edge table, without bringing edges or labels to the driver.

Large-star and small-star rounds: in each, every node links its neighbours to the smallest node it knows. Edges become
stars around the smallest node of their component. Rounds read and write small tables of edges, and a node with very
many neighbours is handled by a partial aggregate and a join whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) after one step: large stars link larger neighbours to the minimum, small stars smaller ones."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select("u", "v")
    smallest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = sides.join(smallest.withColumnRenamed("u", "n"), F.col("u") == F.col("n"))
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v), null ends and loops left out; root is the smallest node.

    An empty table gives an empty one. Repeated edges count once. The result is a written table; the caller may drop it.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    while True:
        then = cut_lineage(_star(_star(now, True), False))
        settled = then.count() == now.count() and then.join(now, ["u", "v"], "left_anti").isEmpty()
        drop_cut(now)
        now = then
        if settled:
            break
    roots = cut_lineage(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    drop_cut(now)
    return roots
