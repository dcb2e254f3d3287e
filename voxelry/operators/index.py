"""Bounding volumes over triangles, and work in numbered chunks.

Closest-place queries here go by grid cells and need no tree.  The tree is for those who want
its nodes: the median split of the triangles' centroids on each node's longest axis, level by
level.  A node is numbered as in a heap: the root is 1, the halves of k are 2k and 2k + 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources.surfaces import Surface
from .geometry import corners

_LOW, _HIGH = [f"l{k}" for k in "xyz"], [f"h{k}" for k in "xyz"]


def _bounds() -> list[Column]:
    return [F.min(c).alias(c) for c in _LOW] + [F.max(c).alias(c) for c in _HIGH]


def tree(surface: Surface, leaf: int = 8, max_depth: int = 32) -> DataFrame:
    """The leaf of each triangle: tri_idx, node, depth and its position in the leaves' order.

    Halves are cut at the middle of the order by centroid; equal centroids keep the order
    that they had, and of equally long axes x comes before y and y before z.  Each level is a
    window over the nodes, so the top one, a single node, is one task's sort.
    """
    t = corners(surface).select("tri_idx", *[f"g{k}" for k in "xyz"], *_LOW, *_HIGH)
    n = t.count()
    open_ = t.withColumns({"node": F.lit(1).cast("bigint"), "depth": F.lit(0), "first": F.lit(0).cast("bigint"), "size": F.lit(n).cast("bigint"), "pos": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("tri_idx")).cast("bigint") - 1})
    for level in range(min(max_depth, max(0, math.ceil(math.log2(max(1, n / leaf)))))):
        own = Window.partitionBy("node")
        wide = [(F.max(f"h{k}").over(own) - F.min(f"l{k}").over(own)).alias(f"w{k}") for k in "xyz"]
        axis = F.when((F.col("wx") >= F.col("wy")) & (F.col("wx") >= F.col("wz")), F.col("gx")).when(F.col("wy") >= F.col("wz"), F.col("gy")).otherwise(F.col("gz"))
        split = F.col("size") > leaf
        rows = open_.select("*", *wide).withColumn("by", F.when(split, axis)).withColumn("rank", F.row_number().over(own.orderBy("by", "pos")).cast("bigint") - 1)
        half = F.floor(F.col("size") / 2)
        right = split & (F.col("rank") >= half)
        open_ = rows.select("tri_idx", *[f"g{k}" for k in "xyz"], *_LOW, *_HIGH, F.when(split, F.col("node") * 2 + right.cast("bigint")).otherwise(F.col("node")).alias("node"), F.when(split, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.when(right, F.col("first") + half).otherwise(F.col("first")).alias("first"), F.when(right, F.col("size") - half).when(split, half).otherwise(F.col("size")).alias("size"), (F.col("first") + F.col("rank")).alias("pos"))
        if level % 6 == 5:
            open_ = cut(open_)
    return open_


def refitted(leaves: DataFrame, surface: Surface) -> DataFrame:
    """The boxes of all nodes for a surface of the same triangles, leaves and branches alike."""
    boxes = corners(surface).select("tri_idx", *_LOW, *_HIGH)
    above = F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("bigint")))
    return leaves.select("tri_idx", "node", "depth").join(boxes, "tri_idx").select(above.alias("node"), *_LOW, *_HIGH).groupBy("node").agg(*_bounds(), F.count("*").alias("triangles"))


def statistics(leaves: DataFrame) -> DataFrame:
    """Numbers of leaves and nodes, and the greatest depth."""
    return leaves.agg(F.countDistinct("node").alias("leaf_count"), (2 * F.countDistinct("node") - 1).alias("node_count"), F.max("depth").alias("max_depth"))


def chunks(spark: SparkSession, n: int, size: int = 256) -> DataFrame:
    """The ranges that n elements are worked off in: chunk, first, last (excluded)."""
    rows = -(-n // size)
    first = F.col("id") * size
    return spark.range(rows).select(F.col("id").alias("chunk"), first.alias("first"), F.least(first + size, F.lit(n)).alias("last"))


def chunked(df: DataFrame, index: str, size: int, *totals: Column) -> DataFrame:
    """The totals of each chunk; adding these up gives those of the whole."""
    return df.groupBy(F.floor(F.col(index) / size).alias("chunk")).agg(*totals)
