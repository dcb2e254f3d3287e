"""Deterministic surface samples, neighbour tiers and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import halton01, quasirandom01
from ..functions.vectors import Vec, box_distance_squared
from ..plans.lineage import cut
from ..sources.surfaces import Surface
from .geometry import A, B, C, corners, cumulative_areas, normal, small

STRATIFIED, LOW_DISCREPANCY = "area_stratified", "low_discrepancy"


def selected_triangles(targets: DataFrame, surface: Surface) -> DataFrame:
    """For each area fraction (``f`` in 0..1) the first triangle whose running area reaches it."""
    running = cumulative_areas(surface)
    total = running.agg(F.max("high").alias("total"))
    asked = targets.crossJoin(F.broadcast(total)).withColumn("target", F.least(F.col("f") * F.col("total"), F.col("total")))  # one row
    first = running.agg(F.min("tri_idx").alias("first_tri"))
    found = asked.crossJoin(F.broadcast(first)).join(small(running.select("tri_idx", "low", "high")), (F.col("target") > F.col("low")) & (F.col("target") <= F.col("high")), "left")
    return found.withColumn("tri_idx", F.coalesce("tri_idx", "first_tri")).drop("total", "target", "low", "high", "first_tri")


def samples(surface: Surface, n: int, seed: int = 11337, pattern: str = STRATIFIED) -> DataFrame:
    """n samples by area, each with its place, its triangle's normal and its barycentric
    coordinates; within a triangle they are numbered in sample order (W02)."""
    spark = surface.vertices.sparkSession
    i = F.col("sample_idx")
    fraction = (i + 0.5) / F.lit(float(n)) if pattern == STRATIFIED else F.least(F.greatest(halton01(i + 1, 2, seed) % F.lit(1.0), F.lit(1e-6)), F.lit(0.999999))
    chosen = selected_triangles(spark.range(n).withColumnRenamed("id", "sample_idx").withColumn("f", fraction), surface)
    local = F.row_number().over(Window.partitionBy("tri_idx").orderBy("sample_idx")) - 1
    chosen = chosen.withColumn("local", local.cast("long"))
    root = F.sqrt(quasirandom01(F.col("local"), F.col("tri_idx"), seed, 0))
    v = quasirandom01(F.col("local"), F.col("tri_idx"), seed, 1)
    bary = chosen.select("sample_idx", "tri_idx", "local", (1 - root).alias("b0"), (root * (1 - v)).alias("b1"), (root * v).alias("b2"))
    return evaluated(bary, surface)


def evaluated(anchors: DataFrame, surface: Surface) -> DataFrame:
    """Place and normal of anchors (tri_idx, b0 .. b2) on a surface of the same triangles."""
    n = normal()
    t = small(corners(surface))
    p = A.times(F.col("b0")).plus(B.times(F.col("b1"))).plus(C.times(F.col("b2")))
    return anchors.join(t, "tri_idx").select(*anchors.columns, *p.aliased(), *n.aliased("n"))


#: Points up to which one side of a nearest-neighbour join is broadcast whole.
FEW_POINTS = 2048


def nearest(a: DataFrame, b: DataFrame, k: int, most: float = 0.0, same: bool = False) -> DataFrame:
    """The k nearest of b for each of a (idx, x, y, z): a_idx, rank, b_idx, d2.

    Ties go to the lower index; ``most`` gates the distance, if it is above zero.  With a
    gate, points meet by the cells of a grid as wide as the gate.  Without one, a small b is
    broadcast; else points meet by cells that hold about k of b, and those that have not got
    k within a cell's width meet again by cells twice as wide, until all have.
    """
    left, right = (d.select(F.col("idx").alias(f"{n}_idx"), *Vec.of().aliased(n)) for n, d in (("a", a), ("b", b)))
    d = Vec.of("a").minus(Vec.of("b"))
    if most > 0:
        return _ranked(_met(left, right, most).withColumn("d2", d.dot(d)).filter(F.col("d2") <= most * most), k, same)
    box = right.agg(F.count("*").alias("n"), *[F.min(f"b{x}").alias(f"l{x}") for x in "xyz"], *[F.max(f"b{x}").alias(f"h{x}") for x in "xyz"]).first()
    if box["n"] <= FEW_POINTS:
        return _ranked(left.crossJoin(F.broadcast(right)).withColumn("d2", d.dot(d)), k, same)
    span = max(box[f"h{x}"] - box[f"l{x}"] for x in "xyz")
    width = max(span * ((k + 1) / box["n"]) ** (1 / 3), 1e-9)
    wanted = min(k, box["n"] - same)
    out, rest = None, cut(left)
    while True:
        best = cut(_ranked(_met(rest, right, width).withColumn("d2", d.dot(d)), k, same))
        # All of b within a cell's width has been met; so what is no farther is final.
        sure = best.groupBy("a_idx").agg(F.count("*").alias("n"), F.max("d2").alias("far")).filter((F.col("n") >= wanted) & (F.col("far") <= width * width)).select("a_idx")
        out = best.join(sure, "a_idx", "left_semi") if out is None else out.unionByName(best.join(sure, "a_idx", "left_semi"))
        rest = cut(rest.join(sure, "a_idx", "left_anti"))
        if rest.isEmpty():
            return out
        if width > span:  # far outside, or fewer than k: everything there is
            return out.unionByName(_outside(rest, right, k, same, span / 16 or 1.0))
        width *= 2


def _met(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of points in the same cell or in neighbouring ones."""
    at = lambda n: dict(zip(("cx", "cy", "cz"), [F.floor(F.col(f"{n}{x}") / width) for x in "xyz"], strict=True))
    left = left.withColumns(at("a"))
    for name, c in at("b").items():
        right = right.withColumn(name, F.explode(F.sequence(c - 1, c + 1)))
    return left.join(right, ["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def _outside(rest: DataFrame, right: DataFrame, k: int, same: bool, width: float) -> DataFrame:
    """For points far from all of b: only the cells that can hold one of the k nearest.

    At most some 5,000 cells (16 along the longest side) are compared with each point.
    """
    cell = F.xxhash64(*[F.floor(F.col(f"b{x}") / width) for x in "xyz"])
    filed = right.withColumn("cell", cell)
    boxes = filed.groupBy("cell").agg(*[F.min(f"b{x}").alias(f"l{x}") for x in "xyz"], *[F.max(f"b{x}").alias(f"h{x}") for x in "xyz"], F.count("*").alias("n"))
    p, low, high = Vec.of("a"), Vec.of("l"), Vec.of("h")
    reach = [F.greatest(F.abs(x - a), F.abs(x - b)) for x, a, b in zip(p, low, high, strict=True)]
    pairs = rest.crossJoin(F.broadcast(boxes)).select(*rest.columns, "cell", "n", box_distance_squared(p, low, high).alias("near"), sum((c * c for c in reach), F.lit(0.0)).alias("far"))
    # The nearest cells that surely hold k (and the point itself) bound the distance.
    enough = F.sum("n").over(Window.partitionBy("a_idx").orderBy("far", "cell"))
    bound = pairs.withColumn("sum", enough).filter(F.col("sum") >= k + same).groupBy("a_idx").agg(F.min("far").alias("bound"))
    d = Vec.of("a").minus(Vec.of("b"))
    some = pairs.join(bound, "a_idx", "left").filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select(*rest.columns, "cell")
    return _ranked(some.join(filed, "cell").withColumn("d2", d.dot(d)), k, same)


def _ranked(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """The k least of each a_idx: kept sorted while adding up, so no pair list is shuffled."""
    pairs = pairs.filter("a_idx <> b_idx") if same else pairs
    order = Window.partitionBy("a_idx").orderBy("d2", "b_idx")
    return pairs.select("a_idx", "b_idx", "d2").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cross_neighborhood(a: DataFrame, b: DataFrame, k: int = 1, most: float = 0.0) -> DataFrame:
    """Both directions."""
    there = nearest(a, b, k, most).withColumn("direction", F.lit("a_to_b"))
    return there.unionByName(nearest(b, a, k, most).withColumn("direction", F.lit("b_to_a")))


def tiers(points: DataFrame, first: int = 6, second: int = 12) -> DataFrame:
    """The nearest others: ranks up to ``first`` are tier 1, the next ``second`` tier 2."""
    near = nearest(points, points, first + second, same=True)
    return near.select(F.col("a_idx").alias("from_node"), F.col("b_idx").alias("to_node"), "rank", F.when(F.col("rank") <= first, 1).otherwise(2).alias("tier"), "d2")


def tier_counts(edges: DataFrame) -> DataFrame:
    """Edges of each tier, and the least and greatest numbers of neighbours."""
    per = edges.groupBy("tier", "from_node").agg(F.count("*").alias("n"))
    return per.groupBy("tier").agg(F.sum("n").alias("edges"), F.min("n").alias("least"), F.max("n").alias("most"))
