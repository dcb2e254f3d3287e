"""Skeletal skinning: vertices moved by the poses of up to four joints.

weights(vertex_idx, slot, joint, weight), poses(frame, joint, x, y, z, qx, qy, qz, qw)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, rotate_by_quaternion
from .geometry import small


def _quaternion(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}q{k}") for k in "xyzw")


def transform_point(p: Vec, prefix: str) -> Vec:
    """rotate, then move."""
    return rotate_by_quaternion(p, *_quaternion(prefix)).plus(Vec.of(prefix))


def inverse_transform_point(p: Vec, prefix: str) -> Vec:
    x, y, z, w = _quaternion(prefix)
    return rotate_by_quaternion(p.minus(Vec.of(prefix)), -x, -y, -z, w)


def _influences(vertices: DataFrame, weights: DataFrame, bind: DataFrame, poses: DataFrame) -> DataFrame:
    named = lambda d, p: d.select("joint", *([F.col("frame")] if p == "f" else []), *[F.col(k).alias(f"{p}{k}") for k in ("x", "y", "z", "qx", "qy", "qz", "qw")])
    return vertices.join(weights.filter("weight > 0"), "vertex_idx").join(small(named(bind, "b")), "joint").join(small(named(poses, "f")), "joint")


def skinned_positions(vertices: DataFrame, weights: DataFrame, bind: DataFrame, poses: DataFrame) -> DataFrame:
    """Weight-normalised blend of the joints' transforms, for each frame and vertex."""
    moved = transform_point(inverse_transform_point(Vec.of(), "b"), "f")
    rows = _influences(vertices, weights, bind, poses).select("frame", "vertex_idx", "weight", *moved.aliased("m"))
    w = F.col("weight")
    return rows.groupBy("frame", "vertex_idx").agg(*[(F.sum(w * F.col(f"m{k}")) / F.sum(w)).alias(k) for k in "xyz"])


def skinned_normals(normals: DataFrame, weights: DataFrame, bind: DataFrame, poses: DataFrame) -> DataFrame:
    """The same with rotations only, unit length again."""
    x, y, z, w = _quaternion("b")
    turned = rotate_by_quaternion(rotate_by_quaternion(Vec.of("n"), -x, -y, -z, w), *_quaternion("f"))
    rows = _influences(normals, weights, bind, poses).select("frame", "vertex_idx", "weight", *turned.aliased("m"))
    sums = rows.groupBy("frame", "vertex_idx").agg(*[F.sum(F.col("weight") * F.col(f"m{k}")).alias(f"s{k}") for k in "xyz"])
    return sums.select("frame", "vertex_idx", *Vec.of("s").normalized_or(Vec.lit(0, 1, 0)).aliased("n"))


def joint_matrices(bind: DataFrame, poses: DataFrame) -> DataFrame:
    """for each frame and joint the matrix from bind pose to pose: m00 .. m22, and m03 .. m23."""
    named = lambda d, p: d.select("joint", *([F.col("frame")] if p == "f" else []), *[F.col(k).alias(f"{p}{k}") for k in ("x", "y", "z", "qx", "qy", "qz", "qw")])
    both = named(bind, "b").join(named(poses, "f"), "joint")
    out = ["frame", "joint"]
    for k in range(4):
        # The images of the origin and of the unit vectors give the columns.
        p = transform_point(inverse_transform_point(Vec.lit(*(float(k == j) for j in range(3))), "b"), "f")
        out += [c.alias(f"p{k}{j}") for j, c in enumerate(p)]
    images = both.select(*out)
    turn = [(F.col(f"p{k}{j}") - F.col(f"p3{j}")).alias(f"m{j}{k}") for j in range(3) for k in range(3)]
    return images.select("frame", "joint", *turn, *[F.col(f"p3{j}").alias(f"m{j}3") for j in range(3)])


def mesh_buffers(weights: DataFrame, bind: DataFrame, poses: DataFrame) -> DataFrame:
    """The blended matrix of every vertex and frame, with its influences and their total."""
    names = [f"m{j}{k}" for j in range(3) for k in range(4)]
    rows = weights.filter("weight > 0").join(joint_matrices(bind, poses), "joint")
    return rows.groupBy("frame", "vertex_idx").agg(F.count("*").alias("influences"), F.sum("weight").alias("total"), *[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])


def compared(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """How many vertices differ by more than the tolerance, and the greatest error."""
    d = Vec.of().minus(Vec.of("o"))
    both = a.join(b.select("frame", "vertex_idx", *Vec.of().aliased("o")), ["frame", "vertex_idx"]).withColumn("error", d.length())
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("error") > tolerance).alias("over"), F.max("error").alias("max_error"))


def nlerp(a: tuple[Column, ...], b: tuple[Column, ...], t: Column) -> tuple[Column, ...]:
    """shortest-arc normalised interpolation of quaternions."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    mixed = [x + (F.when(dot < 0, -y).otherwise(y) - x) * t for x, y in zip(a, b, strict=True)]
    n = F.sqrt(sum((m * m for m in mixed), F.lit(0.0)))
    return tuple(m / F.when(n > 0, n).otherwise(1.0) for m in mixed)


def evaluated_track(keys: DataFrame, times: DataFrame) -> DataFrame:
    """keys(joint, t, value) at times(t): linear between keys, held at the ends.

    An as-of join without a pair list: both tables are laid on one time line and each time
    takes the last key at or before it and the first one after it.
    """
    asked = keys.select("joint").distinct().join(small(times))  # joints x frames: the result's rows
    line = keys.select("joint", "t", "value", F.col("t").alias("key_t"), F.lit(0).alias("kind")).unionByName(asked.select("joint", "t", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("key_t"), F.lit(1).alias("kind")))
    past = Window.partitionBy("joint").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("joint").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    out = line.select("joint", "t", "kind", *[F.last(c, True).over(past).alias(f"a_{c}") for c in ("key_t", "value")], *[F.first(c, True).over(ahead).alias(f"b_{c}") for c in ("key_t", "value")]).filter("kind = 1")
    span = F.col("b_key_t") - F.col("a_key_t")
    mixed = F.col("a_value") + (F.col("b_value") - F.col("a_value")) * (F.col("t") - F.col("a_key_t")) / F.when(span > 0, span).otherwise(1.0)
    return out.select("joint", "t", F.when(F.col("a_value").isNull(), F.col("b_value")).when(F.col("b_value").isNull(), F.col("a_value")).otherwise(mixed).alias("value"))


def picked(n_vertices: int, n: int, spark) -> DataFrame:
    """Evenly spaced vertices, first and last included."""
    return spark.range(n).select(F.col("id").alias("sample_idx"), (F.floor(F.col("id") * (n_vertices - 1) / max(1, n - 1))).alias("vertex_idx"))
