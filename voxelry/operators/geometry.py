"""Triangles with their corners, areas, normals, bounds and inflated surfaces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Named, Vec, finite, triangle_area
from ..sources.surfaces import Surface

A, B, C = (Named(k) for k in "abc")

#: Bytes, by the plan's own estimate, up to which a table is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the plan says that the table has no more bytes than ``most``.

    The estimate costs no job; where joins make it too high, Spark still decides by the sizes
    that it sees at run time.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def corners(surface: Surface) -> DataFrame:
    """Each triangle with ax .. cz, centroid gx .. gz and bounds lx .. hz."""
    vertices = small(surface.vertices)
    out = surface.triangles
    for k in "abc":
        v = vertices.select(F.col("vertex_idx").alias(k), *[F.col(n).alias(f"{k}{n}") for n in "xyz"])
        out = out.join(v, k)
    low, high = A.least(B).least(C), A.greatest(B).greatest(C)
    return out.select("tri_idx", "a", "b", "c", *A.aliased("a"), *B.aliased("b"), *C.aliased("c"), *A.plus(B).plus(C).times(1 / 3).aliased("g"), *low.aliased("l"), *high.aliased("h"))


def normal(fallback: Vec | None = None) -> Vec:
    return B.minus(A).cross(C.minus(A)).normalized_or(fallback or Vec.lit(0, 1, 0))


def areas(surface: Surface) -> DataFrame:
    """Triangle areas; null where degenerate."""
    return corners(surface).select("tri_idx", triangle_area(A, B, C).alias("area"))


def surface_area(surface: Surface) -> DataFrame:
    """The area and the number of triangles that have one."""
    return areas(surface).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count("area").alias("triangles"))


def cumulative_areas(surface: Surface) -> DataFrame:
    """Running area over the triangles in order, degenerate ones left out.

    The order is global, but is summed block by block: one task sees only block totals.
    """
    rows = areas(surface).filter("area is not null").withColumn("block", F.floor(F.col("tri_idx") / 4096))
    within = F.sum("area").over(Window.partitionBy("block").orderBy("tri_idx"))
    totals = rows.groupBy("block").agg(F.sum("area").alias("total"))
    before = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    return rows.withColumn("within", within).join(before, "block").select("tri_idx", "area", (F.col("before") + F.col("within") - F.col("area")).alias("low"), (F.col("before") + F.col("within")).alias("high"))


def bounds(points: DataFrame) -> DataFrame:
    """The box about all points; no row if there are none or one is not finite."""
    p = Vec.of()
    out = points.agg(*[f(n).alias(f"{k}_{n}") for k, f in (("min", F.min), ("max", F.max)) for n in "xyz"], F.bool_and(p.finite()).alias("ok"), F.count("*").alias("n"))
    return out.filter("n > 0 and ok").drop("ok", "n")


def vertex_normals(surface: Surface) -> DataFrame:
    """Area-weighted normals of the vertices, zero where nothing adds up."""
    n = B.minus(A).cross(C.minus(A))
    t = corners(surface).select("a", "b", "c", *n.aliased("n")).filter(Vec.of("n").dot(Vec.of("n")) > 1e-14)
    parts = t.select(F.explode(F.array("a", "b", "c")).alias("vertex_idx"), "nx", "ny", "nz").groupBy("vertex_idx").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    whole = surface.vertices.join(parts, "vertex_idx", "left")
    unit = Vec(*(F.coalesce(F.col(f"n{k}"), F.lit(0.0)) for k in "xyz")).normalized_or(Vec.lit(0, 0, 0))
    return whole.select("vertex_idx", "x", "y", "z", *unit.aliased("n"))


def surface_center(surface: Surface) -> DataFrame:
    """The mean of the vertices."""
    return surface.vertices.agg(*[F.avg(k).alias(k) for k in "xyz"])


def inflated(surface: Surface, distance: float) -> Surface:
    """vertices moved along their normals; without one, away from the centre, else up."""
    if distance == 0:
        return surface
    v = vertex_normals(surface).crossJoin(F.broadcast(surface_center(surface).select(*[F.col(k).alias(f"c{k}") for k in "xyz"])))  # one row
    away = Vec.of().minus(Vec.of("c")).normalized_or(Vec.lit(0, 1, 0))
    n = Vec.of("n").where(Vec.of("n").length() > 0.5, away)
    moved = Vec.of().plus(n.times(float(distance)))
    return Surface(v.select("vertex_idx", *moved.aliased()), surface.triangles)


FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def topology_key(surface: Surface, surface_id: str = "surface") -> DataFrame:
    """Counts and the FNV-1a hash (hexadecimal) of the indices in order.

    The hash depends on the order of all indices, so one surface is one task's work; many
    surfaces are hashed side by side.
    """

    def run(batches):
        h, n = FNV_OFFSET, 0
        for batch in batches:
            a, b, c = (batch.column(k).to_pylist() for k in range(3))
            for corner in zip(a, b, c, strict=True):
                for i in corner:
                    for byte in int(i).to_bytes(4, "little"):
                        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([f"{h:016x}"])], ["triangle_count", "index_hash"])

    hashed = surface.triangles.orderBy("tri_idx").select("a", "b", "c").coalesce(1).mapInArrow(run, "triangle_count long, index_hash string")
    return surface.vertices.agg(F.count("*").alias("vertex_count")).crossJoin(hashed).select(F.lit(surface_id).alias("surface_id"), "vertex_count", "triangle_count", "index_hash")


def valid_surface(surface: Surface) -> DataFrame:
    """The first rule that a surface breaks, or null."""
    n = surface.vertices.agg(F.count("*").alias("n"), F.bool_and(Vec.of().finite()).alias("finite"))
    t = surface.triangles.agg(F.count("*").alias("m"), F.max(F.greatest("a", "b", "c")).alias("high"), F.min(F.least("a", "b", "c")).alias("low"), F.bool_or((F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))).alias("repeated"))
    both = n.crossJoin(t).crossJoin(surface_area(surface).select("area"))  # one row each
    code = (
        F.when((F.col("n") == 0) | (F.col("m") == 0), "mesh.empty_geometry").when(~F.col("finite"), "mesh.non_finite")
        .when((F.col("high") >= F.col("n")) | (F.col("low") < 0), "mesh.index_out_of_range").when(F.col("repeated"), "mesh.repeated_vertex")
        .when(~finite(F.col("area")) | (F.col("area") <= 1e-9), "mesh.no_area")
    )
    return both.select(code.alias("rejection"))
