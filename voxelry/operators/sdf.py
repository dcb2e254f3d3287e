"""Distance grids of surfaces: building, sampling and gradients."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, clamp
from ..sources.surfaces import Surface
from .distance import closest_surface, signed_distance
from .geometry import bounds


class Grid(NamedTuple):
    """voxels(linear, ix, iy, iz, distance), x fastest, and the header."""

    voxels: DataFrame
    origin: tuple[float, float, float]
    voxel: float
    dims: tuple[int, int, int]


class Rejected(ValueError):
    """A contract that an input breaks; the text is the rejection code."""


def grid_header(surface: Surface, voxel: float = 0.1, padding: int = 1, most: int = 1_000_000) -> tuple[tuple, tuple]:
    """Origin and dimensions; checked before any work is done."""
    if not (math.isfinite(voxel) and voxel > 0):
        raise Rejected("sdf.invalid_voxel_size")
    box = bounds(surface.vertices).first()
    if box is None:
        raise Rejected("sdf.invalid_mesh")
    pad = voxel * padding
    origin = tuple(box[f"min_{k}"] - pad for k in "xyz")
    dims = tuple(max(2, math.ceil((box[f"max_{k}"] + pad - o) / voxel - 1e-9)) for k, o in zip("xyz", origin, strict=True))
    if math.prod(dims) > most:
        raise Rejected("sdf.voxel_budget_exceeded")
    return origin, dims


def cells(df: DataFrame, dims: tuple[int, int, int], linear: str = "linear") -> DataFrame:
    """F16: cell coordinates of a linear index."""
    nx, ny, _ = dims
    i = F.col(linear)
    return df.withColumns({"ix": i % nx, "iy": F.floor(i / nx) % ny, "iz": F.floor(i / (nx * ny))})


def build(surface: Surface, voxel: float = 0.1, padding: int = 1, most: int = 1_000_000, signed: bool = True) -> Grid:
    """The (signed) distance at the centre of each voxel."""
    origin, dims = grid_header(surface, voxel, padding, most)
    spark = surface.vertices.sparkSession
    index = cells(spark.range(math.prod(dims)).withColumnRenamed("id", "linear"), dims)
    centre = [(F.lit(o) + (F.col(f"i{k}") + 0.5) * voxel).alias(k) for k, o in zip("xyz", origin, strict=True)]
    found = closest_surface(index.select(F.col("linear").alias("point_idx"), *centre), surface)
    found = signed_distance(found) if signed else found
    voxels = cells(found.select(F.col("point_idx").alias("linear"), "distance", "tests"), dims)
    return Grid(voxels, origin, voxel, dims)


def diagnostics(grid: Grid, triangles: int) -> DataFrame:
    """Work and value range."""
    return grid.voxels.agg(F.count("*").alias("sample_count"), F.sum("tests").alias("triangle_tests"), F.lit(triangles).cast("long").alias("triangle_count"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def _cell(k: str, grid: Grid, at: Column) -> Column:
    o = grid.origin["xyz".index(k)]
    scaled = (at - F.lit(o)) / grid.voxel - 0.5
    return F.when(scaled < 0, None).otherwise(F.floor(scaled + 0.5))


def nearest(points: DataFrame, grid: Grid, clamped: bool = False) -> DataFrame:
    """The value of the cell that a point rounds to; outside: null, or the edge's."""
    keys = {}
    for k, n in zip("xyz", grid.dims, strict=True):
        if clamped:
            o = grid.origin["xyz".index(k)]
            keys[k] = clamp(F.floor((F.col(k) - F.lit(o)) / grid.voxel - 0.5 + 0.5), 0, n - 1).cast("long")
        else:
            c = _cell(k, grid, F.col(k))
            keys[k] = F.when(c < n, c)
    nx, ny, _ = grid.dims
    asked = points.withColumn("linear", keys["x"] + nx * (keys["y"] + ny * keys["z"]))
    return asked.join(grid.voxels.select("linear", F.col("distance").alias("sdf")), "linear", "left")


def gradient(grid: Grid) -> DataFrame:
    """Central differences with neighbours held at the edges, as unit vectors or zero.

    Each voxel is sent to the up to six that need it; no voxel is looked up by a join.
    """
    nx, ny, nz = grid.dims
    steps = []
    for axis, n in enumerate(grid.dims):
        c = F.col("i" + "xyz"[axis])
        for sign in (1, -1):
            # To the neighbour that sees this voxel on its +/- side; at an edge also to itself.
            at = [F.col("ix"), F.col("iy"), F.col("iz")]
            moved = list(at)
            moved[axis] = c - sign
            inside = (moved[axis] >= 0) & (moved[axis] < n)
            index = lambda v: v[0] + nx * (v[1] + ny * v[2])
            edge = c == (n - 1 if sign > 0 else 0)
            steps += [F.when(inside, F.struct(index(moved).alias("to"), F.lit(axis).alias("axis"), (F.col("distance") * sign).alias("part"))), F.when(edge, F.struct(index(at).alias("to"), F.lit(axis).alias("axis"), (F.col("distance") * sign).alias("part")))]
    parts = grid.voxels.select(F.explode(F.array(*steps)).alias("s")).filter("s is not null")
    sums = parts.groupBy(F.col("s.to").alias("linear")).agg(*[F.sum(F.when(F.col("s.axis") == a, F.col("s.part")).otherwise(0.0)).alias(f"g{k}") for a, k in enumerate("xyz")])
    unit = Vec.of("g").normalized_or(Vec.lit(0, 0, 0))
    return sums.select("linear", *unit.aliased("g"))
