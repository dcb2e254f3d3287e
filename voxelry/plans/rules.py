"""Contracts as tables of rules: the first rule that a row breaks gives its rejection code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, finite

Rule = tuple[str, Column]


def first_broken(rules: Sequence[Rule]) -> Column:
    """The code of the first rule whose condition (what must hold) is not true, else null."""
    out = F.lit(None).cast("string")
    for code, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def checked(df: DataFrame, rules: Sequence[Rule], name: str = "rejection") -> DataFrame:
    return df.withColumn(name, first_broken(rules))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def at_least(c: Column, low: float) -> Column:
    return finite(c) & (c >= low)


# Ids of dotted segments, and schema ids that end in a version.
DOTTED = r"^[a-z0-9]([a-z0-9_-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9_-]*[a-z0-9])?)*$"
VERSIONED = r"\.v[1-9][0-9]*$"


def dotted_id(c: Column) -> list[Rule]:
    return [("model.blank_id", ~blank(c)), ("model.invalid_id", c.rlike(DOTTED))]


def schema_id(c: Column, prefix: str) -> list[Rule]:
    return [*dotted_id(c), ("model.invalid_schema_prefix", c.startswith(prefix)), ("model.invalid_schema_segments", F.size(F.split(c, r"\.")) >= 5), ("model.invalid_schema_version", c.rlike(VERSIONED))]


# Public paths and hashes.
ROOTS = ("docs/", "fixtures/", "schemas/", "crates/", "tools/", "http://", "https://")
PRIVATE = ("secret", "private", "password", "internal", "/users/", "/home/")


def private_fragment(c: Column) -> Column:
    out = F.lit(False)
    for word in PRIVATE:
        out = out | F.lower(c).contains(word)
    return out


def public_path(c: Column) -> list[Rule]:
    rooted = F.lit(False)
    for root in ROOTS:
        rooted = rooted | c.startswith(root)
    return [("path.blank", ~blank(c)), ("path.root", rooted), ("path.parent", ~c.contains("..")), ("path.backslash", ~c.contains("\\")), ("path.private", ~private_fragment(c))]


def sha256_hex(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def bounds() -> list[Rule]:
    """min_x .. max_z."""
    low, high = Vec.of("min_"), Vec.of("max_")
    return [("model.non_finite_bounds", low.finite() & high.finite()), ("model.inverted_bounds", (low.x <= high.x) & (low.y <= high.y) & (low.z <= high.z))]


def surface_sample() -> list[Rule]:
    """b0 .. b2, a normal and a place."""
    b = [F.col(f"b{k}") for k in range(3)]
    inside = F.lit(True)
    for c in b:
        inside = inside & c.between(-1e-5, 1 + 1e-5)
    return [("mesh.non_finite_sample", Vec.of().finite() & Vec.of("n").finite()), ("mesh.zero_normal", Vec.of("n").dot(Vec.of("n")) > 1e-10), ("mesh.invalid_barycentric", inside & (F.abs(b[0] + b[1] + b[2] - 1) <= 1e-4))]


def local_frame() -> list[Rule]:
    """Three unit axes at right angles: ux .. wz."""
    u, v, w = Vec.of("u"), Vec.of("v"), Vec.of("w")
    unit = lambda a: F.abs(a.length() - 1) <= 1e-3
    square = lambda a, b: F.abs(a.dot(b)) <= 1e-3
    return [("mesh.axis_length", unit(u) & unit(v) & unit(w)), ("mesh.axis_angle", square(u, v) & square(v, w) & square(u, w))]


def coordinate_frame() -> list[Rule]:
    """P14."""
    return [("mesh.invalid_coordinate_frame_config", at_least(F.col("dx"), 0) & at_least(F.col("dy"), 0) & at_least(F.col("dz"), 0))]


def collider() -> list[Rule]:
    """P15."""
    return [("mesh.invalid_collider_config", at_least(F.col("inflation"), 0) & at_least(F.col("padding"), 0) & at_least(F.col("shell"), 0))]


def sdf_config() -> list[Rule]:
    """P20."""
    return [("sdf.invalid_voxel_size", finite(F.col("voxel_size")) & (F.col("voxel_size") > 0)), ("sdf.invalid_voxel_cap", F.col("max_voxels") > 0)]


def adf_config() -> list[Rule]:
    """P22."""
    return [("adf.invalid_depth", F.col("max_depth").between(0, 16)), ("adf.invalid_cell_cap", F.col("max_cells") > 0), ("adf.invalid_tolerance", at_least(F.col("tolerance"), 0))]


def particle() -> list[Rule]:
    """P24."""
    return [("particle.blank_id", ~blank(F.col("particle_id"))), ("particle.non_finite", Vec.of().finite() & Vec.of("v").finite()), ("particle.invalid_radius", at_least(F.col("radius"), 0)), ("particle.invalid_mass", at_least(F.col("inverse_mass"), 0)), ("particle.invalid_age", at_least(F.col("age"), 0))]


def influence() -> list[Rule]:
    """P27."""
    return [("particle.invalid_influence_config", Vec.of().finite() & at_least(F.col("radius"), 0) & finite(F.col("strength")))]


def body_box() -> list[Rule]:
    """P27."""
    return [("particle.invalid_body_config", first_broken(bounds()).isNull() & at_least(F.col("restitution"), 0))]


def hand_frame() -> list[Rule]:
    """P17."""
    return [("mesh.invalid_hand_payload", at_least(F.col("time_seconds"), 0) & F.forall("confidence", lambda c: c.between(0, 1)) & (F.size("confidence") == F.size("joints")))]


def rig_weights(weights: DataFrame, joints: int) -> DataFrame:
    """Vertices whose weights or joints are not allowed."""
    per = weights.groupBy("vertex_idx").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("joint").alias("high"), F.min("joint").alias("low"), F.count("*").alias("n"))
    return checked(per, [("mesh.invalid_weight", (F.col("least") >= 0) & (F.col("total") <= 1.0001)), ("mesh.joint_out_of_range", (F.col("low") >= 0) & (F.col("high") < joints)), ("mesh.too_many_influences", F.col("n") <= 4)]).select("vertex_idx", "rejection")


def neighbor_lists(edges: DataFrame, nodes: int) -> DataFrame:
    """Edges out of range, to themselves or given twice."""
    twice = edges.groupBy("from_node", "to_node").agg(F.count("*").alias("n"))
    return checked(twice, [("field.neighbor_out_of_range", F.col("to_node").between(0, nodes - 1) & F.col("from_node").between(0, nodes - 1)), ("field.self_neighbor", F.col("from_node") != F.col("to_node")), ("field.duplicate_neighbor", F.col("n") == 1)]).select("from_node", "to_node", "rejection")


def field_buffers(values: DataFrame, nodes: int) -> DataFrame:
    """Each field's buffer has one finite value for each node."""
    per = values.groupBy("field_id").agg(F.count("*").alias("n"), F.countDistinct("node_idx").alias("distinct"), F.bool_and(finite(F.col("value"))).alias("ok"))
    return checked(per, [("field.node_count_mismatch", (F.col("n") == nodes) & (F.col("distinct") == nodes)), ("field.invalid_field", F.col("ok"))]).select("field_id", "rejection")


def perturbations(rows: DataFrame, nodes: int) -> DataFrame:
    """Node lists that are empty, out of range or repeat a node; durations of none."""
    list_ = F.col("node_indices")
    return checked(rows, [("field.empty_perturbation", F.size(list_) > 0), ("field.invalid_perturbation_node", F.forall(list_, lambda x: (x >= 0) & (x < nodes))), ("field.duplicate_perturbation_node", F.size(F.array_distinct(list_)) == F.size(list_)), ("field.invalid_duration", F.col("duration") > 0)])


def strictly_increasing(rows: DataFrame, key: str, step: str) -> DataFrame:
    """Steps of a sequence begin at zero and increase."""
    from pyspark.sql import Window

    before = F.lag(step).over(Window.partitionBy(key).orderBy("ord"))
    return rows.withColumn("ok", F.when(before.isNull(), F.col(step) == 0).otherwise(F.col(step) > before)).groupBy(key).agg(F.bool_and("ok").alias("increasing"))


def frequencies(rows: DataFrame) -> DataFrame:
    """Outcome frequencies in 0..1 that add up to one."""
    total = F.aggregate("frequencies", F.lit(0.0), lambda a, x: a + x)
    return checked(rows, [("field.invalid_field", F.forall("frequencies", lambda x: x.between(0, 1))), ("field.invalid_sum", F.abs(total - 1) <= 0.001)])


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
