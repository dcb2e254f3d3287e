"""Scalar and vector fields on a graph of surface nodes, stepped in fixed time steps.

nodes(node_idx, x, y, z, nx, ny, nz), edges(from_node, to_node, tier),
scalars(field_id, node_idx, value), vectors(node_idx, vx, vy, vz),
schedule(ord, node_idx, start_step, duration, effect, field_id, amount, px, py, pz).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Named, Vec, clamp, clamp_length, project_to_tangent

N, V = Named("n"), Named("v")


@dataclass(frozen=True)
class Config:
    dt: float = 1 / 30
    diffusion: float = 2.4
    decay: float = 0.25
    second_tier_weight: float = 0.35
    alignment: float = 3.0
    gradient_gain: float = 1.6
    low: float = 0.0
    high: float = 1.0
    max_length: float = 1.0


def plan(edges: DataFrame, second_tier_weight: float = 0.35, second_tier: bool = True) -> DataFrame:
    """Links with their weights."""
    rows = edges if second_tier else edges.filter("tier = 1")
    return rows.select("from_node", "to_node", F.when(F.col("tier") == 1, 1.0).otherwise(second_tier_weight).alias("weight"))


def active(schedule: DataFrame, step: int) -> DataFrame:
    """Perturbations whose interval holds the step."""
    return schedule.filter((F.col("start_step") <= step) & (F.lit(step) < F.col("start_step") + F.col("duration")))


def _folded(rows: DataFrame, keys: list[str], start: Column, add) -> DataFrame:
    """An ordered fold of few rows for each key."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "effect", "amount"))).alias("todo")).withColumn("todo", F.aggregate("todo", start, add))


def perturbed_scalars(scalars: DataFrame, schedule: DataFrame, step: int) -> DataFrame:
    """In list order, ``wound`` sets the value and ``depolarize`` adds to it.

    As later rows only set or add, a fold is a number to start from (or none) and a sum.
    """
    todo = active(schedule, step).filter("effect in ('wound', 'depolarize')")
    start = F.struct(F.lit(None).cast("double").alias("base"), F.lit(0.0).alias("sum"))
    wound = lambda x: x["effect"] == "wound"
    add = lambda a, x: F.struct(F.when(wound(x), x["amount"]).otherwise(a["base"]).alias("base"), F.when(wound(x), 0.0).otherwise(a["sum"] + x["amount"]).alias("sum"))
    folded = _folded(todo, ["field_id", "node_idx"], start, add)
    return scalars.join(folded, ["field_id", "node_idx"], "left").select("field_id", "node_idx", F.when(F.col("todo").isNull(), F.col("value")).otherwise(F.coalesce("todo.base", "value") + F.col("todo.sum")).alias("value"))


def coupling(nodes: DataFrame, schedule: DataFrame, step: int) -> DataFrame:
    """The product of the active ``coupling`` factors of each node, else one."""
    todo = active(schedule, step).filter("effect = 'coupling'")
    product = _folded(todo, ["node_idx"], F.lit(1.0), lambda a, x: a * x["amount"]).withColumnRenamed("todo", "coupling")
    return nodes.select("node_idx").join(product, "node_idx", "left").select("node_idx", F.coalesce("coupling", F.lit(1.0)).alias("coupling"))


def perturbed_vectors(vectors: DataFrame, schedule: DataFrame, step: int) -> DataFrame:
    """``polarity_set`` replaces the vector, ``polarity_invert`` turns it round."""
    todo = active(schedule, step).filter("effect in ('polarity_set', 'polarity_invert')")
    one = F.array_sort(F.collect_list(F.struct("ord", "effect", "px", "py", "pz")))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.lit(1.0).alias("sign"))
    put = lambda x: x["effect"] == "polarity_set"
    add = lambda a, x: F.struct(*[F.when(put(x), x[f"p{k}"]).otherwise(a[k]).alias(k) for k in "xyz"], F.when(put(x), 1.0).otherwise(-a["sign"]).alias("sign"))
    folded = todo.groupBy("node_idx").agg(F.aggregate(one, start, add).alias("todo"))
    return vectors.join(folded, "node_idx", "left").select("node_idx", *[F.when(F.col("todo").isNull(), F.col(f"v{k}")).otherwise(F.coalesce(F.col(f"todo.{k}"), F.col(f"v{k}")) * F.col("todo.sign")).alias(f"v{k}") for k in "xyz"])


def neighbor_means(values: DataFrame, links: DataFrame) -> DataFrame:
    """Link-weighted means of the neighbours' values, one row for each field and node that has links."""
    there = values.select("field_id", F.col("node_idx").alias("to_node"), F.col("value").alias("there"))
    return links.join(there, "to_node").groupBy("field_id", F.col("from_node").alias("node_idx")).agg((F.sum(F.col("weight") * F.col("there")) / F.sum("weight")).alias("mean"))


def scalar_step(scalars: DataFrame, links: DataFrame, coupled: DataFrame, c: Config) -> DataFrame:
    """Diffusion towards the neighbours' mean, and decay."""
    both = scalars.join(neighbor_means(scalars, links), ["field_id", "node_idx"], "left").join(coupled, "node_idx")
    x = F.col("value")
    new = x + c.dt * (c.diffusion * F.col("coupling") * (F.coalesce("mean", x) - x) - c.decay * x)
    return both.select("field_id", "node_idx", clamp(new, c.low, c.high).alias("value"), (clamp(new, c.low, c.high) != new).cast("int").alias("clamped"))


def vector_targets(vectors: DataFrame, signal: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Of each node, the tangent mean of its neighbours' vectors and the gradient of the signal."""
    here = nodes.join(signal.select("node_idx", "value"), "node_idx").select(F.col("node_idx").alias("from_node"), *Vec.of().aliased(), *N.aliased("n"), F.col("value").alias("here"))
    there = nodes.select("node_idx", *Vec.of().aliased("t")).join(signal.select("node_idx", F.col("value").alias("there")), "node_idx").join(vectors, "node_idx").withColumnRenamed("node_idx", "to_node")
    pairs = links.join(here, "from_node").join(there, "to_node")
    along = project_to_tangent(Vec.of("t").minus(Vec.of()), N).normalized_or(Vec.lit(0, 0, 0))
    rise = along.times(F.col("there") - F.col("here"))
    w = F.col("weight")
    flat = pairs.select("from_node", "weight", *project_to_tangent(V, N).aliased("m"), *rise.aliased("g"))
    return flat.groupBy(F.col("from_node").alias("node_idx")).agg(*[(F.sum(w * F.col(f"{p}{k}")) / F.sum(w)).alias(f"{p}{k}") for p in "mg" for k in "xyz"])


def vector_step(vectors: DataFrame, signal: DataFrame, nodes: DataFrame, links: DataFrame, coupled: DataFrame, c: Config) -> DataFrame:
    """Alignment with the neighbours and response to the gradient, in the tangent plane."""
    both = vectors.join(vector_targets(vectors, signal, nodes, links), "node_idx", "left").join(coupled, "node_idx").join(nodes.select("node_idx", *N.aliased("n")), "node_idx")
    flat = project_to_tangent(V, N)
    has = F.col("mx").isNotNull()
    k = F.col("coupling") * c.dt
    pull = Vec.of("m").minus(flat).times(k * c.alignment).plus(Vec.of("g").times(k * c.gradient_gain))
    new = flat.plus(pull).where(has, flat)
    return both.select("node_idx", *clamp_length(project_to_tangent(new, N), c.max_length).aliased("v"))


def step(scalars: DataFrame, vectors: DataFrame, nodes: DataFrame, links: DataFrame, schedule: DataFrame, index: int, signal_field: str, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Perturbations, then scalars, then vectors by the already updated scalars."""
    scalars = perturbed_scalars(scalars, schedule, index)
    vectors = perturbed_vectors(vectors, schedule, index)
    coupled = coupling(nodes, schedule, index)
    scalars = scalar_step(scalars, links, coupled, c).drop("clamped")
    vectors = vector_step(vectors, scalars.filter(F.col("field_id") == signal_field), nodes, links, coupled, c)
    return scalars, vectors


def value_ranges(scalars: DataFrame) -> DataFrame:
    """A21, A23."""
    return scalars.groupBy("field_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def max_vector_length(vectors: DataFrame) -> DataFrame:
    """A22."""
    return vectors.agg(F.max(V.length()).alias("max_length"))
