"""Adaptive distance fields: octrees over distance grids."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec
from ..plans.lineage import cut
from .geometry import small
from .sdf import Grid, Rejected


class Field(NamedTuple):
    cells: DataFrame  # cell_idx, level, ox, oy, oz, extent, center_distance, min_distance, max_distance, sample_count
    origin: tuple[float, float, float]
    extent: float
    max_depth: int


def build(grid: Grid, max_depth: int = 4, max_cells: int = 4096, tolerance: float = 0.025) -> Field:
    """Split cubes that hold more than one sample and a range above the tolerance.

    One round for each level; a level's cubes are one aggregation of the voxels that are
    still to be split.  Leaves are numbered depth first, children by z, then y, then x.
    """
    if not 0 <= max_depth <= 16 or max_cells <= 0 or tolerance < 0:
        raise Rejected("adf.invalid_config")
    n = max(grid.dims)
    extent = n * grid.voxel
    # Half-open membership of the voxels' centres: which of 2^level intervals (i + 1/2) is in.
    voxels = cut(grid.voxels.select("linear", "ix", "iy", "iz", "distance"))
    live = voxels.drop("linear")
    spark = live.sparkSession
    cubes = spark.createDataFrame([(0, 0, 0)], "kx long, ky long, kz long")
    leaves, count = None, 0
    for level in range(max_depth + 1):
        parts = 2**level
        of = lambda k: F.floor((F.col(f"i{k}") + 0.5) * parts / n)
        keyed = live.withColumns({f"k{k}": of(k) for k in "xyz"})
        stats = keyed.groupBy("kx", "ky", "kz").agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.count("*").alias("sample_count"))
        all_ = cut(cubes.join(stats, ["kx", "ky", "kz"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0))))
        split = (F.col("sample_count") > 1) & (F.col("max_distance") - F.col("min_distance") > tolerance) if level < max_depth else F.lit(False)
        done = all_.filter(~F.coalesce(split, F.lit(False))).withColumn("level", F.lit(level))
        leaves = done if leaves is None else leaves.unionByName(done)
        inner = all_.filter(F.coalesce(split, F.lit(False))).select("kx", "ky", "kz")
        inside = inner.count()
        count += all_.count() - inside
        if count + 8 * inside > max_cells:
            raise Rejected("adf.cell_budget_exceeded")
        if level == max_depth:
            break
        eight = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for z in (0, 1) for y in (0, 1) for x in (0, 1)])
        cubes = inner.select(F.explode(eight).alias("c"), "kx", "ky", "kz").select(*[(F.col(f"k{k}") * 2 + F.col(f"c.{k}")).alias(f"k{k}") for k in "xyz"])
        live = keyed.join(small(inner), ["kx", "ky", "kz"], "left_semi").select("ix", "iy", "iz", "distance")
    size = F.lit(extent) / F.pow(F.lit(2.0), F.col("level"))
    corner = {f"o{k}": F.lit(o) + F.col(f"k{k}") * F.col("extent") for k, o in zip("xyz", grid.origin, strict=True)}
    placed = leaves.withColumn("extent", size).withColumns(corner)
    # The centre's value, from the voxel that it rounds to, held inside the grid.
    key = {f"v{k}": F.least(F.greatest(F.floor((F.col(f"o{k}") + F.col("extent") / 2 - F.lit(o)) / grid.voxel - 0.5 + 0.5), F.lit(0)), F.lit(m - 1)) for k, o, m in zip("xyz", grid.origin, grid.dims, strict=True)}
    nx, ny, _ = grid.dims
    placed = placed.withColumns(key).withColumn("linear", F.col("vx") + nx * (F.col("vy") + ny * F.col("vz")))
    centre = voxels.select("linear", F.col("distance").alias("center_distance"))
    placed = placed.join(centre, "linear")
    # Depth first: the Morton code of the first finest cube in it.
    shift = F.pow(F.lit(2), F.lit(max_depth) - F.col("level")).cast("long")
    bits = lambda k, at: F.when(F.col(f"k{k}").isNotNull(), (F.floor(F.col(f"k{k}") * shift / (1 << at)) % 2))
    morton = sum((bits(k, at) * F.lit(1 << (3 * at + j)) for at in range(max_depth) for j, k in enumerate("xyz")), F.lit(0))
    order = F.row_number().over(Window.orderBy("morton")) - 1  # at most max_cells rows
    lo, hi = F.coalesce("min_distance", "center_distance"), F.coalesce("max_distance", "center_distance")
    cells = placed.withColumn("morton", morton).withColumn("cell_idx", order.cast("long"))
    return Field(cells.select("cell_idx", "level", "ox", "oy", "oz", "extent", "center_distance", lo.alias("min_distance"), hi.alias("max_distance"), "sample_count"), grid.origin, extent, max_depth)


def summary(field: Field) -> DataFrame:
    """A34; every split makes eight cells of one, so their number follows from the leaves'."""
    return field.cells.agg(F.count("*").alias("cell_count"), ((F.count("*") - 1) / 7).cast("long").alias("split_count"), F.max("level").alias("max_level"), F.min("min_distance").alias("min_distance"), F.max("max_distance").alias("max_distance"))


def index(field: Field) -> DataFrame:
    """Every finest cube and the leaf that it is in."""
    span = F.pow(F.lit(2), F.lit(field.max_depth) - F.col("level")).cast("long")
    first = {f"k{k}": F.round((F.col(f"o{k}") - F.lit(o)) / (field.extent / 2**field.max_depth)).cast("long") for k, o in zip("xyz", field.origin, strict=True)}
    out = field.cells.withColumns(first).withColumn("span", span)
    for k in "xyz":
        out = out.withColumn(f"k{k}", F.explode(F.sequence(F.col(f"k{k}"), F.col(f"k{k}") + F.col("span") - 1)))
    return out.select("kx", "ky", "kz", "cell_idx", "center_distance", "level")


def sample(points: DataFrame, field: Field) -> DataFrame:
    """The leaf that contains each point (half open), or null outside.

    The quotient of a point on a wall may round to the cube before or after it, so the cube is
    settled by the walls themselves, which are the leaves' corners to the last bit.
    """
    step = field.extent / 2**field.max_depth
    near, keys = {}, {}
    for k, o in zip("xyz", field.origin, strict=True):
        at, cube = F.col(k), F.col(f"k{k}")
        near[f"k{k}"] = F.when((at >= o) & (at < o + field.extent), F.floor((at - F.lit(o)) / step))
        keys[f"k{k}"] = F.when(at < F.lit(o) + cube * step, cube - 1).when(at >= F.lit(o) + (cube + 1) * step, cube + 1).otherwise(cube)
    return points.withColumns(near).withColumns(keys).join(small(index(field)), ["kx", "ky", "kz"], "left").drop("kx", "ky", "kz")


def gradient(points: DataFrame, field: Field) -> DataFrame:
    """Central differences at the finest step, samples held inside the field.

    Unit vectors or zero, and the length ``rise`` that the differences had.
    """
    step = field.extent / 2**field.max_depth
    rim = max(1e-6 * field.extent, 1e-6)
    stencil = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(s)).alias("sign")) for a in range(3) for s in (1, -1)])
    at = points.select("point_idx", "x", "y", "z", F.explode(stencil).alias("s"))
    moved = {k: F.least(F.greatest(F.col(k) + F.when(F.col("s.axis") == a, F.col("s.sign") * step).otherwise(0.0), F.lit(o)), F.lit(o + field.extent - rim)) for a, (k, o) in enumerate(zip("xyz", field.origin, strict=True))}
    got = sample(at.withColumns(moved), field)
    sums = got.groupBy("point_idx").agg(*[F.sum(F.when(F.col("s.axis") == a, F.col("s.sign") * F.col("center_distance")).otherwise(0.0)).alias(f"g{k}") for a, k in enumerate("xyz")])
    return sums.select("point_idx", *Vec.of("g").normalized_or(Vec.lit(0, 0, 0)).aliased("g"), Vec.of("g").length().alias("rise"))
