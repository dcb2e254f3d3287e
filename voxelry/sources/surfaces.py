"""Procedural surfaces and the entities derived from the driver's tables.

A surface is two long tables: vertices(vertex_idx, x, y, z) and triangles(tri_idx, a, b, c).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit_direction, unit_hash

VERTICES = "vertex_idx long, x double, y double, z double"
TRIANGLES = "tri_idx long, a long, b long, c long"


class Surface(NamedTuple):
    vertices: DataFrame
    triangles: DataFrame


def literal(spark: SparkSession, vertices: list[tuple[float, float, float]], triangles: list[tuple[int, int, int]]) -> Surface:
    return Surface(
        spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vertices)], VERTICES),
        spark.createDataFrame([(i, *t) for i, t in enumerate(triangles)], TRIANGLES),
    )


def unit_triangle(spark: SparkSession) -> Surface:
    return literal(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])


def unit_square(spark: SparkSession) -> Surface:
    return literal(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])


def unit_tetrahedron(spark: SparkSession) -> Surface:
    return literal(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])


def _quads(spark: SparkSession, rows: int, columns: int, first: str, second: str) -> DataFrame:
    """Two triangles for each quad of a grid of rows x columns quads."""
    width = columns + 1
    q = spark.range(rows * columns).select(F.col("id").alias("q"), (F.floor(F.col("id") / columns) * width + F.col("id") % columns).alias("a"))
    corner = {"a": F.col("a"), "b": F.col("a") + 1, "c": F.col("a") + width, "d": F.col("a") + width + 1}
    both = F.array(*[F.struct((F.col("q") * 2 + k).alias("tri_idx"), *[corner[x].alias(n) for x, n in zip(t, "abc", strict=True)]) for k, t in enumerate((first, second))])
    return q.select(F.inline(both))


def wavy_grid(spark: SparkSession, n: int = 16, phase: float = 0.0) -> Surface:
    """n x n quads over the unit square about the origin, with a gentle wave."""
    u, v = (F.col("id") % (n + 1)) / F.lit(float(n)), F.floor(F.col("id") / (n + 1)) / F.lit(float(n))
    z = 0.04 * F.sin(u * (2 * math.pi) + phase) * F.cos(v * (2 * math.pi))
    vertices = spark.range((n + 1) * (n + 1)).select(F.col("id").alias("vertex_idx"), (u - 0.5).alias("x"), (v - 0.5).alias("y"), z.alias("z"))
    return Surface(vertices, _quads(spark, n, n, "abc", "bdc"))


# Half width of the body along its axis (z, width), piecewise linear.
HALF_WIDTHS = ((-1.0, 0.045), (-0.62, 0.110), (-0.18, 0.150), (0.24, 0.145), (0.66, 0.105), (1.0, 0.060))


def half_width_at(z: Column) -> Column:
    z = F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))
    out = F.lit(HALF_WIDTHS[-1][1])
    for (z0, w0), (z1, w1) in reversed(list(zip(HALF_WIDTHS, HALF_WIDTHS[1:], strict=False))):
        out = F.when(z <= z1, w0 + (w1 - w0) * ((z - z0) / (z1 - z0))).otherwise(out)
    return out


def axis_surface(spark: SparkSession, axial: int = 28, lateral: int = 8) -> Surface:
    """A leaf-shaped body along z."""
    width = lateral + 1
    z = -1.0 + 2.0 * F.floor(F.col("id") / width) / F.lit(float(axial))
    side = -1.0 + 2.0 * (F.col("id") % width) / F.lit(float(lateral))
    y = 0.018 * (1 - side * side) * (1 - 0.15 * F.abs(z))
    vertices = spark.range((axial + 1) * width).select(F.col("id").alias("vertex_idx"), (side * half_width_at(z)).alias("x"), y.alias("y"), z.alias("z"))
    return Surface(vertices, _quads(spark, axial, lateral, "acb", "bcd"))


def spiral_particles(spark: SparkSession, n: int) -> DataFrame:
    """Particles on layers of 64 lanes, turning about z."""
    lane, layer = F.col("id") % 64, F.floor(F.col("id") / 64)
    angle, r = lane * 0.618034 * (2 * math.pi), 0.18 + (lane % 8) * 0.008
    x, y = r * F.cos(angle), r * F.sin(angle)
    return spark.range(n).select(F.col("id").alias("particle_idx"), x.alias("x"), y.alias("y"), (F.sin(layer * 0.017) * 0.12).alias("z"), (y * -0.03).alias("vx"), (x * 0.03).alias("vy"), F.lit(0.0).alias("vz"), F.lit(0.01).alias("radius"), F.lit(1.0).alias("inverse_mass"), F.lit(0.0).alias("age"))


def random_sphere(spark: SparkSession, n: int, radius: float, surface_radius: float, seed: int) -> DataFrame:
    """A cloud in a ball: hashed directions, velocities towards the centre."""
    x, y, z = unit_direction(F.col("id"), seed)
    r = F.pow(unit_hash(F.col("id"), seed + 113), F.lit(1 / 3)) * radius
    speed = -0.025 * surface_radius
    return spark.range(n).select(F.col("id").alias("particle_idx"), (x * r).alias("x"), (y * r).alias("y"), (z * r).alias("z"), (x * speed).alias("vx"), (y * speed).alias("vy"), (z * speed).alias("vz"))


def points(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """point_idx, x, y, z from three dimensions of the embeddings."""
    e = lambda k: F.element_at("embedding", first + k).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("point_idx"), *[e(k).alias(n) for k, n in enumerate("xyz")])


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles from the embeddings; those of label 0 are pinned."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    names = ("x", "y", "z"), ("vx", "vy", "vz")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("particle_idx"), *[e(k + 1).alias(n) for k, n in enumerate(names[0])], *[e(k + 7).alias(n) for k, n in enumerate(names[1])], F.lit(0.01).alias("radius"), F.when(F.col("label") == 0, 0.0).otherwise(1.0).alias("inverse_mass"), F.lit(0.0).alias("age"))
