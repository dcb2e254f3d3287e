"""Local frames at surface samples, displacements in them, and packed exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, clamp, finite
from ..sources.surfaces import Surface
from .geometry import topology_key
from .sampling import evaluated

UP, RIGHT = (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)


def with_axes(df: DataFrame, normal: Vec) -> DataFrame:
    """three axes about a normal (ux .. wz); the helper is up unless the normal nearly is.

    Each axis is a projection of its own: written into one another, the expressions grow as
    a power of their nesting.
    """
    up, right = Vec.lit(*UP), Vec.lit(*RIGHT)
    w, u, helper = Vec.of("w"), Vec.of("u"), Vec.of("__h")
    out = df.select("*", *normal.normalized_or(up).aliased("w"))
    out = out.select("*", *up.where(F.abs(w.dot(up)) < 0.92, right).aliased("__h"))
    out = out.select("*", *helper.cross(w).aliased("__c")).select("*", *Vec.of("__c").normalized_or(right).aliased("u"))
    out = out.drop(*[f"__c{k}" for k in "xyz"]).select("*", *w.cross(u).aliased("__c"))
    return out.select("*", *Vec.of("__c").normalized_or(up).aliased("v")).drop(*[f"__{n}{k}" for n in "hc" for k in "xyz"])


def frames(samples: DataFrame, most: tuple[float, float, float] = (0.05, 0.05, 0.05)) -> DataFrame:
    """An anchor, three axes (ux .. wz) and the greatest displacement along each."""
    out = with_axes(samples, Vec.of("n"))
    return out.select("sample_idx", *Vec.of().aliased(), *[f"{a}{k}" for a in "uvw" for k in "xyz"], *Vec.lit(*most).aliased("m"))


def clamped_driver(driver: Vec, ellipsoid: bool = True) -> Vec:
    """within the unit box, or the unit ball; what isn't finite is zero."""
    inside = Vec(*(clamp(F.when(finite(c), c).otherwise(0.0), -1, 1) for c in driver))
    n = inside.length()
    return inside.times(F.when(n > 1, 1 / F.when(n > 0, n).otherwise(1.0)).otherwise(1.0)) if ellipsoid else inside


def displaced(framed: DataFrame, driver: Vec, ellipsoid: bool = True) -> DataFrame:
    """each anchor moved along its axes."""
    out = framed.select("*", *clamped_driver(driver, ellipsoid).aliased("__d"))
    p = Vec.of()
    for axis, k in zip("uvw", "xyz", strict=True):
        p = p.plus(Vec.of(axis).times(F.col(f"__d{k}") * F.col(f"m{k}")))
    return out.select("sample_idx", *p.aliased())


def updated(anchors: DataFrame, surface: Surface) -> DataFrame:
    """The samples' places on a deformed surface of the same triangles."""
    return evaluated(anchors.select("sample_idx", "tri_idx", "b0", "b1", "b2"), surface)


def surface_changes(before: Surface | None, after: Surface) -> DataFrame:
    """What an update means: initialized, updated or resampled_topology."""
    new = topology_key(after)
    if before is None:
        return new.select(F.lit("initialized").alias("outcome"))
    old = topology_key(before).select(F.col("index_hash").alias("old_hash"), F.col("vertex_count").alias("old_count"))
    same = (F.col("index_hash") == F.col("old_hash")) & (F.col("vertex_count") == F.col("old_count"))
    return new.crossJoin(old).select(F.when(same, "updated").otherwise("resampled_topology").alias("outcome"))  # one row each


def packed_nodes(nodes: DataFrame, index: str, *columns: str) -> DataFrame:
    """One row for each element: its index and its numbers as an array; missing: 0."""
    return nodes.select(F.col(index).alias("idx"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("packed"))


def packed_samples(points: DataFrame, closest: DataFrame) -> DataFrame:
    """Each point's closest sample as numbers: hit, place, normal, distance, triangle, and
    triangles tested as nodes, leaves and triangles; a miss is a single zero."""
    tests = F.col("tests").cast("double")
    numbers = F.array(F.lit(1.0), *[F.col(f"{v}{k}") for v in "qn" for k in "xyz"], F.col("distance"), F.col("tri_idx").cast("double"), F.lit(0.0), F.lit(0.0), tests)
    hit = closest.select("point_idx", numbers.alias("numbers"))
    return points.select("point_idx").join(hit, "point_idx", "left").select("point_idx", F.coalesce("numbers", F.array(F.lit(0.0))).alias("packed"))


def region_lists(regions: DataFrame) -> DataFrame:
    """Regions with the running offset of their nodes in the flattened list.

    regions(region, node_idx)
    """
    per = regions.groupBy("region").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node_idx")).alias("nodes"))
    before: Column = F.sum("n").over(Window.orderBy("region")) - F.col("n")  # a row for each region
    return per.select("region", before.alias("first"), "n", "nodes")
