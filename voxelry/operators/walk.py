"""Neighbours by the way along a surface.

J07: the graph joins each triangle's corners and three points on each of its edges with one
another, each sample with those of its triangle and with the other samples there, and given
pairs of vertices (bridges).  J06: distances spread along the links in rounds, from all
origins at once; an origin stops looking farther than its k-th nearest sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec
from ..plans.lineage import cut
from ..sources.surfaces import Surface
from .geometry import corners, small

SUBDIVISIONS = 4


def _ring() -> list:
    """Names and places of a triangle's 12 boundary nodes; edge points go by the lower vertex first."""
    out = [(F.concat(F.lit("v"), F.col(k).cast("string")), Vec.of(k)) for k in "abc"]
    for p, q in ("ab", "bc", "ca"):
        low = F.col(p) <= F.col(q)
        start, end = Vec.of(p).where(low, Vec.of(q)), Vec.of(q).where(low, Vec.of(p))
        for s in range(1, SUBDIVISIONS):
            t = s / SUBDIVISIONS
            name = F.concat_ws("_", F.concat(F.lit("e"), F.least(p, q).cast("string")), F.greatest(p, q).cast("string"), F.lit(str(s)))
            out.append((name, start.times(1 - t).plus(end.times(t))))
    return out


def graph(surface: Surface, samples: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """Links (a, b, length) in both directions; the shortest of several between two nodes."""
    ring = F.array(*[F.struct(name.alias("node"), *place.aliased()) for name, place in _ring()])
    nodes = corners(surface).select("tri_idx", F.inline(ring))
    own = samples.select("tri_idx", F.concat(F.lit("s"), F.col("sample_idx").cast("string")).alias("node"), "x", "y", "z")
    all_ = nodes.unionByName(own)
    a, b = (all_.select("tri_idx", F.col("node").alias(k), *Vec.of().aliased(k)) for k in "ab")
    d = Vec.of("a").minus(Vec.of("b"))
    links = a.join(b, "tri_idx").filter("a <> b").select("a", "b", d.length().alias("length"))
    if bridges is not None:
        v = surface.vertices
        ends = bridges.join(v.select(F.col("vertex_idx").alias("from_vertex"), *Vec.of().aliased("a")), "from_vertex").join(v.select(F.col("vertex_idx").alias("to_vertex"), *Vec.of().aliased("b")), "to_vertex")
        name = lambda k: F.concat(F.lit("v"), F.col(k).cast("string"))
        one = ends.select(name("from_vertex").alias("a"), name("to_vertex").alias("b"), d.length().alias("length"))
        links = links.union(one).union(one.select("b", "a", "length"))
    return links.groupBy("a", "b").agg(F.min("length").alias("length"))


def neighbors(surface: Surface, samples: DataFrame, k: int, bridges: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """The k nearest samples along the surface: from_node, to_node, rank, distance."""
    links = cut(graph(surface, samples, bridges))
    name = F.concat(F.lit("s"), F.col("sample_idx").cast("string"))
    reached = cut(samples.select(F.col("sample_idx").alias("origin"), name.alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")))
    order = Window.partitionBy("origin").orderBy("distance")
    for _ in range(most_rounds):
        is_sample = F.col("node").startswith("s") & (F.col("distance") > 0)
        limit = reached.filter(is_sample).withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("origin", F.col("distance").alias("limit"))
        front = reached.filter("fresh").join(small(links.withColumnRenamed("a", "node")), "node").select("origin", F.col("b").alias("node"), (F.col("distance") + F.col("length")).alias("distance"))
        front = front.join(limit, "origin", "left").filter(F.col("limit").isNull() | (F.col("distance") <= F.col("limit"))).groupBy("origin", "node").agg(F.min("distance").alias("new"))
        both = reached.join(front, ["origin", "node"], "full")
        better = F.col("distance").isNull() | (F.col("new") < F.col("distance"))
        reached = cut(both.select("origin", "node", F.least("distance", "new").alias("distance"), F.coalesce(F.col("new").isNotNull() & better, F.lit(False)).alias("fresh")))
        if reached.filter("fresh").isEmpty():
            break
    found = reached.filter(F.col("node").startswith("s") & (F.col("node") != F.concat(F.lit("s"), F.col("origin").cast("string"))))
    found = found.select(F.col("origin").alias("from_node"), F.substring("node", 2, 20).cast("bigint").alias("to_node"), "distance")
    rank = F.row_number().over(Window.partitionBy("from_node").orderBy("distance", "to_node"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def tiers(surface: Surface, samples: DataFrame, first: int, second: int, bridges: DataFrame | None = None) -> DataFrame:
    """Ranks up to ``first`` are tier 1, the next ``second`` tier 2."""
    return neighbors(surface, samples, first + second, bridges).withColumn("tier", F.when(F.col("rank") <= first, 1).otherwise(2))
