"""An animated surface frame by frame: what an update means, when forces are refreshed, what
particles see of the surface, and status rows.

Frames, sequences and probes are rows, so any number of them are answered side by side; only
``stepped`` is a loop over frames, which holds plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec
from ..plans.lineage import cut
from ..sources.surfaces import Surface
from . import particles as P
from .distance import closest_surface, outward

# The markers of the sources of particle forces, by code.
SOURCES = ("mesh-distance", "none", "sdf-field", "adf-field")


def named(code: Column, names: tuple[str, ...], first: int = 0) -> Column:
    """the name of a code, null beyond the list."""
    place = F.greatest(code - first + 1, F.lit(1)).cast("int")
    return F.when(code >= first, F.try_element_at(F.array(*[F.lit(n) for n in names]), place))


def update_outcomes(frames: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """frames(sequence, frame_idx, topology (null: invalid surface), collider (enabled)).

    ``sampler`` is initialized, updated or resampled_topology; ``collider`` also disabled and
    changed_topology; ``refit`` says that the distance index keeps its tree.  An invalid
    surface changes nothing, so what counts is the last valid frame before.
    """
    before = F.last("topology", True).over(Window.partitionBy(sequence).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1))
    here = F.col("topology")
    kind = lambda changed: F.when(here.isNull(), "invalid_surface").when(F.col("before").isNull(), "initialized").when(here == F.col("before"), "updated").otherwise(changed)
    rows = frames.withColumn("before", before)
    return rows.select(sequence, "frame_idx", kind("resampled_topology").alias("sampler"), F.when(~F.col("collider"), "disabled").otherwise(kind("changed_topology")).alias("collider"), F.coalesce(here == F.col("before"), F.lit(False)).alias("refit"))


def refresh_plan(frames: DataFrame) -> DataFrame:
    """frames(frame_idx, source, interval): whether forces are fresh, reused or disabled."""
    fresh = F.col("frame_idx") % F.col("interval") == 0
    return frames.select("*", F.when(F.col("source") == "none", "disabled").otherwise("ready").alias("status"), F.when(F.col("source") == "none", "disabled").when(fresh, "fresh").otherwise("reused").alias("refresh"), (F.when(F.col("source") == "mesh-distance", fresh).otherwise(F.col("source") != "none")).alias("forced"))


def refreshed_distances(particles: DataFrame, surface: Surface) -> DataFrame:
    """The distance of each particle to the surface, null where it has none, and the tests."""
    near = closest_surface(particles.withColumnRenamed("particle_idx", "point_idx"), surface).select(F.col("point_idx").alias("particle_idx"), "distance", "tests")
    return particles.select("particle_idx").join(near, "particle_idx", "left")


def refresh_counts(distances: DataFrame) -> DataFrame:
    """How many particles were sampled, and how many triangles were tested."""
    return distances.agg(F.count("*").alias("particles"), F.count("distance").alias("refreshed_samples"), F.coalesce(F.sum("tests"), F.lit(0)).alias("triangle_tests"))


def force_probe(particles: DataFrame, force: DataFrame, most: int, strength: float = 19.0, scale: float = 0.65, least: float = 0.0008) -> DataFrame:
    """The first particles whose force can be sampled, with the acceleration that is expected.

    force(particle_idx, distance, ox, oy, oz; null: no sample).  ``rejected`` counts those
    without one before the last that was taken (all, if there are too few).
    """
    rows = particles.select("particle_idx", "x", "y", "z", "radius").join(force, "particle_idx", "left")
    ok = rows.filter("distance is not null").orderBy("particle_idx").limit(most)
    last = ok.agg(F.max("particle_idx").alias("last"), F.count("*").alias("sampled"))
    missed = rows.filter("distance is null").select("particle_idx").crossJoin(F.broadcast(last)).agg(F.count_if((F.col("sampled") < most) | (F.col("particle_idx") < F.col("last"))).alias("rejected"))  # one row each
    target = F.greatest(F.col("radius") * scale, F.lit(least))
    a = Vec.of("o").normalized_or(Vec.lit(0, 1, 0)).times(-(F.col("distance") - target) * strength)
    return ok.crossJoin(F.broadcast(missed)).select("particle_idx", "distance", target.alias("target_distance"), *a.aliased("a"), "rejected")


def unforced_step(particles: DataFrame, dt: float, centre: tuple[float, float, float], cloud_radius: float, surface_radius: float, near: DataFrame | None = None, *, confinement: float = 1.12, hold: float = 7.0, strength: float = 19.0, damping: float = 1.55, speed: float = 1.9, scale: float = 0.65, least: float = 0.0008) -> DataFrame:
    """One substep of all particles.

    near(particle_idx, distance, ox, oy, oz) is what a force sampler says; particles that it
    has no sample of only age.  Without it they are held together, damped, limited and moved.
    Particles of no inverse mass only age.
    """
    out = particles.select(*P.COLUMNS)
    if near is not None:
        out = out.join(near.select("particle_idx", "distance", "ox", "oy", "oz"), "particle_idx", "left")
        moving = (F.col("inverse_mass") != 0) & F.col("distance").isNotNull()
        target = F.greatest(F.col("radius") * scale, F.lit(least))
        pull = Vec.of("o").normalized_or(Vec.lit(0, 1, 0)).times(-(F.col("distance") - target) * strength)
    else:
        moving, pull = F.col("inverse_mass") != 0, Vec.lit(0, 0, 0)
    away = P.X.minus(Vec.lit(*centre))
    out = out.select("*", moving.alias("__moving"), *pull.aliased("__p"), *away.aliased("__w"), away.length().alias("__n"))
    back = Vec.of("__w").normalized_or(Vec.lit(0, 1, 0)).times(F.when(F.col("__n") > confinement * cloud_radius, -(F.col("__n") - cloud_radius) * hold).otherwise(0.0))
    v = P.V.plus(Vec.of("__p").plus(back).times(dt)).times(max(0.0, min(1.0, 1 - damping * dt)))
    out = out.select("*", *v.aliased("__v"))
    out = out.select("*", *P.clamp_speed(Vec.of("__v"), speed * surface_radius).aliased("__s"))
    new = Vec.of("__s")
    moved = P.X.plus(new.times(dt))
    here = F.col("__moving")
    return out.select("particle_idx", *moved.where(here, P.X).aliased(), *new.where(here, P.V).aliased("v"), "radius", "inverse_mass", (F.col("age") + dt).alias("age"))


def stepped(particles: DataFrame, surface: Surface, source: str, interval: int, frames: int, dt: float, centre: tuple[float, float, float], cloud_radius: float, surface_radius: float, grid=None) -> DataFrame:
    """Particles after so many frames under a force source.

    Distances to the mesh are asked for in every ``interval``-th frame, and between these the
    particles go on without a surface force; a grid's force is there in every frame.
    """
    from . import sdf

    for k in range(frames):
        near = None
        asked = particles.withColumnRenamed("particle_idx", "point_idx")
        if source == "mesh-distance" and k % interval == 0:
            near = outward(closest_surface(asked, surface)).withColumnRenamed("point_idx", "particle_idx")
        elif source == "sdf-field":
            got = sdf.nearest(asked, grid, clamped=True).join(sdf.gradient(grid).select("linear", *Vec.of("g").aliased("o")), "linear")
            near = got.select(F.col("point_idx").alias("particle_idx"), F.col("sdf").alias("distance"), "ox", "oy", "oz")
        particles = unforced_step(particles, dt, centre, cloud_radius, surface_radius, near)
        if k % 4 == 3:  # so that the plan doesn't grow with the frames
            particles = cut(particles)
    return particles


def status(surface: Surface, particles: DataFrame, distances: DataFrame, source: str = SOURCES[0], interval: int = 1) -> DataFrame:
    """What the runtime holds, in one row."""
    rows = [surface.vertices.agg(F.count("*").alias("vertex_count")), surface.triangles.agg(F.count("*").alias("triangle_count")), particles.agg(F.count("*").alias("particle_count")), distances.agg(F.count("distance").alias("distance_samples"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row each
    return out.select("*", F.lit(source).alias("source"), F.lit(interval).alias("interval"))


def steps_of_call(requested: Column, most: int = 8) -> Column:
    """The steps that one call runs: at least one, at most ``most``."""
    return F.least(F.greatest(requested, F.lit(1)), F.lit(most))


def nearest_nodes(nodes: DataFrame, centre: tuple[float, float, float], count: int) -> DataFrame:
    """The nodes nearest to a place, ties by index."""
    d = Vec.of().minus(Vec.lit(*centre))
    return nodes.select("node_idx", d.dot(d).alias("d2")).orderBy("d2", "node_idx").limit(count)


def running_bounds(frames: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """The box about all frames up to each: frames(sequence, frame_idx, min_x .. max_z)."""
    past = Window.partitionBy(sequence).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(sequence, "frame_idx", *[f(f"{m}_{k}").over(past).alias(f"{m}_{k}") for m, f in (("min", F.min), ("max", F.max)) for k in "xyz"])


def public_links(fixtures: DataFrame, inputs: DataFrame) -> DataFrame:
    """fixtures(fixture_id, kind, path, sha256) against inputs(fixture_id, kind, path, sha256)."""
    there = inputs.select("fixture_id", "kind", F.col("path").alias("p"), F.col("sha256").alias("h"))
    code = F.when(F.col("p").isNull(), "link.missing").when((F.col("path") != F.col("p")) | (F.col("sha256") != F.col("h")), "link.mismatch")
    return fixtures.join(there, ["fixture_id", "kind"], "left").select("fixture_id", "kind", code.alias("rejection"))


def axis_range(origin: Column, voxel: Column, dimension: Column, cell: Column, extent: Column) -> tuple[Column, Column]:
    """the half-open span of voxels whose centres lie in a cell, along one axis."""
    ceil = lambda v: F.when(F.coalesce(v <= 0, F.lit(True)) | F.isnan(v), F.lit(0)).otherwise(F.least(F.ceil(v), dimension))
    end = ceil((cell + extent - origin) / voxel - 0.5)
    return F.least(ceil((cell - origin) / voxel - 0.5), end), end


def debug_layers(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Nodes with each layer's value and the layer's range: values(layer, node_idx, value)."""
    ranges = values.groupBy("layer").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return nodes.join(values, "node_idx").join(ranges, "layer").select("layer", "node_idx", "x", "y", "z", "value", "least", "most")


def circuit_layers(state: DataFrame) -> DataFrame:
    """A circuit's voltage, memory and readout as layers, with their ranges."""
    long = state.select("node_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(k).cast("double").alias("value")) for k in ("voltage", "memory", "readout")])).alias("l")).select("node_idx", "l.layer", "l.value").filter("value is not null")
    ranges = long.groupBy("layer").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return long.join(ranges, "layer")


def zero_step_summary(scalars: DataFrame, vectors: DataFrame, perturbations: DataFrame) -> DataFrame:
    """What a run of no steps is about: fields(field_id, node_idx, value), vectors(node_idx, vx, vy, vz)."""
    s = scalars.agg(F.countDistinct("field_id").alias("scalar_fields"), F.countDistinct("node_idx").alias("nodes"), F.min("value").alias("scalar_min"), F.max("value").alias("scalar_max"))
    v = vectors.agg(F.max(Vec.of("v").length()).alias("max_vector_length"))
    p = perturbations.agg(F.count("*").alias("perturbations"))
    return s.crossJoin(v).crossJoin(p).withColumn("steps", F.lit(0))  # one row each


def circuit_status(state: DataFrame, edges: DataFrame, terms: DataFrame, mapped: DataFrame, step: int, dt: float) -> DataFrame:
    """A circuit's status: counts, the active terms, and means over the ends of the body."""
    both = state.join(mapped.select("node_idx", "region"), "node_idx")
    mean = lambda c, *regions: F.coalesce(F.avg(F.when(F.col("region").isin(*regions), F.col(c))), F.lit(0.0))
    one = both.agg(F.count("*").alias("nodes"), mean("memory", 1, 2).alias("posterior_memory"), mean("readout", 1, 2).alias("posterior_readout"), mean("readout", 5).alias("head_readout"), mean("readout", 1).alias("tail_readout"), F.max("voltage").alias("max_voltage"), F.min("voltage").alias("min_voltage"))
    due = (F.col("start_step") <= step) & (F.col("duration").isNull() | (F.lit(step) < F.col("start_step") + F.col("duration")))
    more = edges.agg(F.count("*").alias("edges")).crossJoin(terms.agg(F.count("*").alias("terms"), F.count_if(due).alias("active_terms")))
    return one.crossJoin(more).select("*", F.lit(step).alias("step"), F.lit(step * dt).alias("time_seconds"))
