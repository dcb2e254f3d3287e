"""The closest place of a surface to each point, exactly, and what follows from it.

Pairing every point with every triangle costs points x triangles.  That is what happens
for surfaces of up to ``FEW`` triangles, which are broadcast.  Beyond, triangles are filed
under the cells of a grid that their boxes touch, and points look in rings of cells about
their own: all that lies within r cells of a point is at most so far away, so a distance
found that is no greater than r cells is final.  Only points without one go on to the next
ring, twice as wide, and those beyond the last ring look only at boxes of triangles that can
hold the closest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Named, Vec, box_distance_squared, with_closest_on_triangle
from ..plans.lineage import cut
from ..sources.surfaces import Surface
from .geometry import corners, normal

FEW = 512
RINGS = 3

P, Q = Named("p"), Named("q")


def _exact(pairs: DataFrame) -> DataFrame:
    """Squared distance and closest place for pairs with px .. pz and a triangle's corners."""
    out = with_closest_on_triangle(pairs)
    d = P.minus(Q)
    return out.select("*", d.dot(d).alias("d2"))


def _best() -> Column:
    n = normal()
    row = F.struct("d2", "tri_idx", *Q.aliased("q"), *n.aliased("n"))
    return F.min(row).alias("best")  # by distance, ties to the lowest triangle


def _told(best: DataFrame) -> DataFrame:
    f = lambda k: F.col(f"best.{k}")
    return best.select("point_idx", "px", "py", "pz", f("tri_idx").alias("tri_idx"), F.sqrt(f("d2")).alias("distance"), *[f(f"{v}{k}").alias(f"{v}{k}") for v in "qn" for k in "xyz"], "tests")


def closest_surface(points: DataFrame, surface: Surface, cell: float | None = None) -> DataFrame:
    """For each finite point (point_idx, x, y, z) the closest triangle, the place on
    it, its normal, the distance, and how many triangles were tested."""
    p = points.filter(Vec.of().finite()).select("point_idx", *Vec.of().aliased("p"))
    triangles = corners(surface)
    keys = ["point_idx", "px", "py", "pz"]
    if cell is None and triangles.limit(FEW + 1).count() <= FEW:
        pairs = p.crossJoin(F.broadcast(triangles))  # at most FEW triangles
        return _told(_exact(pairs).groupBy(*keys).agg(_best(), F.count("*").alias("tests")))
    if cell is None:
        box = triangles.agg(*[(F.max(f"h{k}") - F.min(f"l{k}")).alias(k) for k in "xyz"], F.count("*").alias("n")).first()
        cell = max(max(box["x"], box["y"], box["z"]) / max(1.0, box["n"] ** 0.5), 1e-9)
    return _bucketed(p, triangles, cell, keys)


def _bucketed(p: DataFrame, triangles: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    span = lambda k: F.sequence(F.floor(F.col(f"l{k}") / cell), F.floor(F.col(f"h{k}") / cell))
    filed = triangles.withColumn("kx", F.explode(span("x"))).withColumn("ky", F.explode(span("y"))).withColumn("kz", F.explode(span("z")))
    bounds = [F.min(f"k{k}").alias(f"lo{k}") for k in "xyz"] + [F.max(f"k{k}").alias(f"hi{k}") for k in "xyz"]
    box = filed.agg(*bounds).first()
    filed = cut(filed)
    out, rest, r = None, p, 1
    for _ in range(RINGS):
        own = lambda k: F.floor(F.col(f"p{k}") / cell)
        low = lambda k: F.greatest(own(k) - r, F.lit(box[f"lo{k}"]))
        high = lambda k: F.least(own(k) + r, F.lit(box[f"hi{k}"]))
        asked = rest.filter((low("x") <= high("x")) & (low("y") <= high("y")) & (low("z") <= high("z")))
        for k in "xyz":
            asked = asked.withColumn(f"k{k}", F.explode(F.sequence(low(k), high(k))))
        pairs = asked.join(filed, ["kx", "ky", "kz"]).dropDuplicates(["point_idx", "tri_idx"])
        best = _exact(pairs).groupBy("point_idx").agg(_best(), F.count("*").alias("tests"))
        both = cut(rest.join(best, "point_idx", "left").withColumn("sure", F.coalesce(F.col("best.d2") <= F.lit((r * cell) ** 2), F.lit(False))))
        sure, rest = both.filter("sure").drop("sure"), both.filter("not sure").select(*keys)
        out = sure if out is None else out.unionByName(sure)
        if rest.isEmpty():
            return _told(out)
        r *= 2
    return _told(out.unionByName(_far(rest, triangles, keys)))


def _far(rest: DataFrame, triangles: DataFrame, keys: list[str]) -> DataFrame:
    """For points farther out: only triangles in boxes that can be the nearest.

    The triangles' centres are filed under at most some 5,000 cells (16 along the longest
    side); a box whose nearest place is farther than another's farthest corner is left out.
    """
    box = triangles.agg(*[(F.max(f"g{k}") - F.min(f"g{k}")).alias(k) for k in "xyz"]).first()
    width = max(box) / 16 or 1.0
    filed = triangles.withColumn("cell", F.xxhash64(*[F.floor(F.col(f"g{k}") / width) for k in "xyz"]))
    boxes = filed.groupBy("cell").agg(*[F.min(f"l{k}").alias(f"l{k}") for k in "xyz"], *[F.max(f"h{k}").alias(f"h{k}") for k in "xyz"])
    low, high = Vec.of("l"), Vec.of("h")
    reach = [F.greatest(F.abs(x - a), F.abs(x - b)) for x, a, b in zip(P, low, high, strict=True)]
    pairs = rest.crossJoin(F.broadcast(boxes)).select(*keys, "cell", box_distance_squared(P, low, high).alias("near"), sum((c * c for c in reach), F.lit(0.0)).alias("reach"))
    some = pairs.withColumn("bound", F.min("reach").over(Window.partitionBy("point_idx"))).filter(F.col("near") <= F.col("bound")).select(*keys, "cell")
    return _exact(some.join(filed, "cell")).groupBy(*keys).agg(_best(), F.count("*").alias("tests"))


def signed_distance(closest: DataFrame) -> DataFrame:
    """Negative behind the triangle's normal."""
    side = P.minus(Q).dot(Vec.of("n"))
    return closest.withColumn("distance", F.when(side < 0, -F.col("distance")).otherwise(F.col("distance")))


def outward(closest: DataFrame) -> DataFrame:
    """the unit vector away from the surface; on the surface, its normal."""
    away = P.minus(Q).normalized_or(Vec.of("n"))
    return closest.select("*", *away.aliased("o"))


def contacts(probes: DataFrame, surface: Surface, padding: float = 0.0) -> DataFrame:
    """Each probe (with ``radius``) and its closest contact, if it is a finite point.

    ``touches`` compares the distance with the radius, ``overlaps`` with radius and padding.
    """
    found = closest_surface(probes, surface).select("point_idx", "tri_idx", "distance", *Q.aliased("q"))
    both = probes.join(found, "point_idx", "left")
    pad = max(padding, 0.0)
    return both.select("point_idx", "radius", "tri_idx", "distance", "qx", "qy", "qz", F.coalesce(F.col("distance") <= F.col("radius"), F.lit(False)).alias("touches"), F.coalesce(F.col("distance") <= F.greatest("radius", F.lit(0.0)) + pad, F.lit(False)).alias("overlaps"))


def contact_counts(rows: DataFrame) -> DataFrame:
    """A19."""
    return rows.agg(F.count("*").alias("probes"), F.count("tri_idx").alias("contacts"), F.count_if("touches").alias("touching"), F.count_if("overlaps").alias("overlapping"))
