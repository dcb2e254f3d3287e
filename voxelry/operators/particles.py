"""Particles: one fixed step as a DataFrame transformation, and whole frames.

All forces read the positions of before the step, so a step is a set of joins against the
particle table and one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Named, Vec, clamp_speed

X, V = Named(), Named("v")
COLUMNS = ("particle_idx", "x", "y", "z", "vx", "vy", "vz", "radius", "inverse_mass", "age")


class Influence(NamedTuple):
    x: float
    y: float
    z: float
    radius: float
    strength: float
    mode: str = "attract"  # repel, attract, gaussian


class Impulse(NamedTuple):
    x: float
    y: float
    z: float
    radius: float
    dx: float
    dy: float
    dz: float


class Sphere(NamedTuple):
    x: float
    y: float
    z: float
    radius: float
    restitution: float = 0.0


class Box(NamedTuple):
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    restitution: float = 0.0


def neighbor_forces(particles: DataFrame, radius: float, strength: float) -> DataFrame:
    """Repulsion of particles within the radius, met by the cells of a grid as wide.

    Returns particle_idx, fx, fy, fz and how many candidates were looked at.
    """
    cell = {f"c{k}": F.floor(F.col(k) / radius) for k in "xyz"}
    own = particles.select("particle_idx", *X.aliased()).withColumns(cell)
    other = particles.select(F.col("particle_idx").alias("other_idx"), *X.aliased("o"))
    for k in "xyz":
        c = F.floor(F.col(f"o{k}") / radius)
        other = other.withColumn(f"c{k}", F.explode(F.sequence(c - 1, c + 1)))
    d = X.minus(Vec.of("o"))
    pairs = own.join(other, ["cx", "cy", "cz"]).filter("particle_idx <> other_idx").withColumn("d2", d.dot(d))
    n = F.sqrt(F.col("d2"))
    near = (F.col("d2") > 1e-12) & (F.col("d2") <= radius * radius)
    push = d.times(F.when(near, (1 - n / radius) * strength / n).otherwise(0.0))
    return pairs.groupBy("particle_idx").agg(*[F.sum(c).alias(f"f{k}") for k, c in zip("xyz", push, strict=True)], F.count("*").alias("checks"))


def influence(p: Vec, given: Sequence[Influence]) -> tuple[Vec, Column]:
    """Pull or push of a few points, and how many reach p."""
    total, hits = Vec.lit(0, 0, 0), F.lit(0)
    for g in given:
        if g.radius <= 0 or g.strength == 0:
            continue
        at = Vec.lit(g.x, g.y, g.z)
        d = p.minus(at) if g.mode == "repel" else at.minus(p)
        n = d.length()
        ok = (n > 1e-6) & (n <= g.radius)
        t = n / g.radius
        falloff = F.exp(-4 * t * t) if g.mode == "gaussian" else 1 - t
        total = total.plus(d.times(F.when(ok, falloff * g.strength / n).otherwise(0.0)))
        hits = hits + ok.cast("int")
    return total, hits


def impulse(p: Vec, inverse_mass: Column, given: Sequence[Impulse]) -> tuple[Vec, Column]:
    """One-shot changes of velocity, scaled by inverse mass; zero radius: exact hits."""
    total, hits = Vec.lit(0, 0, 0), F.lit(0)
    for g in given:
        n = p.minus(Vec.lit(g.x, g.y, g.z)).length()
        falloff = F.when(n <= 1e-6, 1.0).otherwise(0.0) if g.radius <= 0 else F.when(n <= g.radius, 1 - n / g.radius).otherwise(0.0)
        total = total.plus(Vec.lit(g.dx, g.dy, g.dz).times(falloff * inverse_mass))
        hits = hits + (falloff > 0).cast("int")
    return total, hits


def reflected(v: Vec, n: Vec, restitution: float) -> Vec:
    """a velocity that goes into a body turned round, as far as the restitution has it."""
    inward = v.dot(n)
    return v.minus(n.times(F.when(inward < 0, inward * (1 + restitution)).otherwise(0.0)))


def against_body(df: DataFrame, body: Sphere | Box) -> DataFrame:
    """Push particles out of a body and turn their inward velocity."""
    if isinstance(body, Sphere):
        centre, r = Vec.lit(body.x, body.y, body.z), F.col("radius") + body.radius
        d = X.minus(centre)
        n = d.length()
        hit = n < r
        unit = Vec.lit(1, 0, 0).where(n <= 1e-6, d.times(1 / F.when(n > 0, n).otherwise(1.0)))
        moved, turned = centre.plus(unit.times(r)), reflected(V, unit, body.restitution)
    else:
        low, high = Vec.lit(*body.low), Vec.lit(*body.high)
        low, high = Vec(*(c - F.col("radius") for c in low)), Vec(*(c + F.col("radius") for c in high))
        hit = F.lit(True)
        for c, a, b in zip(X, low, high, strict=True):
            hit = hit & (c >= a) & (c <= b)
        gaps = [g for c, a, b in zip(X, low, high, strict=True) for g in (c - a, b - c)]
        side = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1  # the first of equals
        axis = lambda k: F.when(side == 2 * k, -1.0).when(side == 2 * k + 1, 1.0).otherwise(0.0)
        unit = Vec(axis(0), axis(1), axis(2))
        moved = Vec(*(F.when(side == 2 * k, low[k]).when(side == 2 * k + 1, high[k]).otherwise(X[k]) for k in range(3)))
        turned = reflected(V, unit, body.restitution)
    new = dict(zip("xyz", moved.where(hit & F.col("moving"), X), strict=True)) | {f"v{k}": c for k, c in zip("xyz", turned.where(hit & F.col("moving"), V), strict=True)}
    return df.withColumns(new | {"collisions": F.col("collisions") + (hit & F.col("moving")).cast("int")})


def step(particles: DataFrame, dt: float, *, influences: Sequence[Influence] = (), impulses: Sequence[Impulse] = (), bodies: Sequence[Sphere | Box] = (), neighbor_radius: float = 0.0, neighbor_strength: float = 0.0, damping: float = 0.1, max_speed: float = 4.0, force: DataFrame | None = None) -> DataFrame:
    """Ages, forces, velocity, impulses, damping, speed limit, move, bodies in order.

    ``force``: particle_idx, ax, ay, az of any further field, as an acceleration.  Returns
    the particles with the step's counters: checks, influences, impulses, clamped, collisions.
    """
    out = particles.select(*COLUMNS)
    a = Vec.lit(0, 0, 0)
    if neighbor_radius > 0 and neighbor_strength != 0:
        out = out.join(neighbor_forces(particles, neighbor_radius, neighbor_strength), "particle_idx", "left")
        a = a.plus(Vec(*(F.coalesce(F.col(f"f{k}"), F.lit(0.0)) for k in "xyz")))
        checks = F.coalesce("checks", F.lit(0))
    else:
        checks = F.lit(0).cast("long")
    if force is not None:
        out = out.join(force.select("particle_idx", "ax", "ay", "az"), "particle_idx", "left")
        a = a.plus(Vec(*(F.coalesce(F.col(f"a{k}"), F.lit(0.0)) for k in "xyz")))
    pull, pulled = influence(X, influences)
    kick, kicked = impulse(X, F.col("inverse_mass"), impulses)
    moving = F.col("inverse_mass") != 0
    v = V.plus(a.plus(pull).times(dt)).plus(kick).times(max(0.0, min(1.0, 1 - damping * dt)))
    out = out.select("particle_idx", *X.aliased(), *V.where(~moving, v).aliased("v"), "radius", "inverse_mass", (F.col("age") + dt).alias("age"), moving.alias("moving"), F.when(moving, checks).otherwise(0).alias("checks"), F.when(moving, pulled).otherwise(0).alias("influences"), F.when(moving, kicked).otherwise(0).alias("impulses"))
    over = F.col("moving") & (V.length() > max_speed)
    slow = clamp_speed(V, max_speed).where(F.col("moving"), V)
    out = out.withColumn("clamped", over.cast("int")).withColumns({f"v{k}": c for k, c in zip("xyz", slow, strict=True)})
    out = out.withColumns(dict(zip("xyz", X.plus(V.times(dt)).where(F.col("moving"), X), strict=True)) | {"collisions": F.lit(0)})
    for body in bodies:
        out = against_body(out, body)
    return out.drop("moving")


def counters(stepped: DataFrame) -> DataFrame:
    """Sums of a step's counters and the greatest speed."""
    return stepped.agg(F.count("*").alias("particle_count"), *[F.sum(k).cast("long").alias(k) for k in ("checks", "influences", "impulses", "clamped", "collisions")], F.max(V.length()).alias("max_speed"))


def fixed_steps(accumulated: float, delta: float, step_seconds: float, most: int) -> tuple[int, int, float]:
    """Steps to run, steps dropped, and the time that is left over."""
    if delta <= 0:
        return 0, 0, accumulated
    total = accumulated + delta
    due = int((total + 1e-9 * step_seconds) // step_seconds)
    run = min(due, most)
    return run, due - run, max(0.0, total - due * step_seconds)


def frame(particles: DataFrame, delta: float, step_seconds: float = 1 / 60, most: int = 4, **forces) -> tuple[DataFrame, int, int]:
    """As many fixed steps as fit; impulses go into the first."""
    run, dropped, _ = fixed_steps(0.0, delta, step_seconds, most)
    for k in range(run):
        particles = step(particles, step_seconds, **forces).select(*COLUMNS)
        forces = {**forces, "impulses": ()} if k == 0 else forces
    return particles, run, dropped


def grid_force(particles: DataFrame, grid, mode: str = "attract", target: float = 0.0, strength: float = 4.0) -> DataFrame:
    """Acceleration towards (or away from) a distance of a grid's surface; none if
    one of the six neighbouring samples lies outside."""
    from . import sdf

    h = grid.voxel
    stencil = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(s)).alias("sign")) for a, s in ((-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (2, 1), (2, -1))])
    at = particles.select("particle_idx", *X.aliased(), F.explode(stencil).alias("s")).withColumns({k: F.col(k) + F.when(F.col("s.axis") == a, F.col("s.sign") * h).otherwise(0.0) for a, k in enumerate("xyz")})
    got = sdf.nearest(at, grid)
    part = lambda a: F.sum(F.when(F.col("s.axis") == a, F.col("s.sign") * F.col("sdf")).otherwise(0.0))
    sums = got.groupBy("particle_idx").agg(*[part(a).alias(f"g{k}") for a, k in enumerate("xyz")], F.max(F.when(F.col("s.axis") == -1, F.col("sdf"))).alias("d"), F.count("sdf").alias("n")).filter("n = 7")
    g = Vec.of("g").normalized_or(Vec.lit(0, 1, 0))
    d = F.col("d") - target
    if mode == "attract":
        a = g.times(-d * strength)
    else:
        band = max(abs(target), h)
        a = g.times(F.when(F.abs(F.col("d")) <= band, (1 - F.abs(F.col("d")) / band) * strength).otherwise(0.0))
    return sums.select("particle_idx", *a.aliased("a"))


def render_payload(particles: DataFrame) -> DataFrame:
    """What a renderer needs of each particle."""
    return particles.select("particle_idx", *X.aliased(), "radius", V.length().alias("speed"), "age")


def render_bounds(particles: DataFrame) -> DataFrame:
    """The box about all particles with their radii; no row without particles."""
    r = F.col("radius")
    return particles.agg(F.count("*").alias("n"), *[F.min(F.col(k) - r).alias(f"min_{k}") for k in "xyz"], *[F.max(F.col(k) + r).alias(f"max_{k}") for k in "xyz"]).filter("n > 0")
