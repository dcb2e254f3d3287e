"""Queries of the surface runtime, indexes, files, exports and what else needs no field or circuit."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .catalog import _PART, _REGION, N, _body, _circuit, _nodes, _rig, closest_sql, points_sql, query, told, wavy, wavy_sql
from .functions import hashing, vectors
from .functions.vectors import Vec, rounded
from .operators import coordinates, distance, geometry, index, particles, runtime, sampling, sdf, skinning
from .sources import artifacts, glb, surfaces


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


# Fixture shapes.


def _literal_sql(points, faces) -> str:
    rows = [f"('vertex', {k}, {float(x)!r}, {float(y)!r}, {float(z)!r})" for k, (x, y, z) in enumerate(points)] + [f"('face', {k}, {float(a)!r}, {float(b)!r}, {float(c)!r})" for k, (a, b, c) in enumerate(faces)]
    return f"SELECT kind, idx::BIGINT AS idx, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM (VALUES {', '.join(rows)}) t(kind, idx, x, y, z)"


SQUARE = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])
TRIANGLE = ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])


def _shape(s: surfaces.Surface):
    v = s.vertices.select(F.lit("vertex").alias("kind"), F.col("vertex_idx").cast("bigint").alias("idx"), "x", "y", "z")
    t = s.triangles.select(F.lit("face").alias("kind"), F.col("tri_idx").cast("bigint").alias("idx"), *[F.col(a).cast("double").alias(k) for a, k in zip("abc", "xyz", strict=True)])
    return v.union(t)


@query("S14_unit_square", _literal_sql(*SQUARE))
def _(spark, d):
    return _shape(surfaces.unit_square(spark))


@query("S15_unit_triangle", _literal_sql(*TRIANGLE))
def _(spark, d):
    return _shape(surfaces.unit_triangle(spark))


@query("A05_topology_hash", "SELECT 4::BIGINT AS vertex_count, 2::BIGINT AS triangle_count, printf('%x', 16112794849697168423::UBIGINT) AS index_hash")
def _(spark, d):
    return geometry.topology_key(surfaces.unit_square(spark)).select("vertex_count", "triangle_count", "index_hash")


# Trees and chunks.


def _tree_sql(levels: int, n: int) -> str:
    out = f"{wavy_sql()}, t0 AS (SELECT tri_idx, (ax+bx+cx)/3 AS gx, (ay+\"by\"+cy)/3 AS gy, (az+bz+cz)/3 AS gz, least(ax,bx,cx) AS lx, greatest(ax,bx,cx) AS hx, least(ay,\"by\",cy) AS ly, greatest(ay,\"by\",cy) AS hy, least(az,bz,cz) AS lz, greatest(az,bz,cz) AS hz, 1::BIGINT AS node, tri_idx AS pos, {n}::BIGINT AS size FROM faces)"
    for k in range(levels):
        out += f""", w{k} AS (SELECT *, max(hx) OVER p - min(lx) OVER p AS wx, max(hy) OVER p - min(ly) OVER p AS wy, max(hz) OVER p - min(lz) OVER p AS wz FROM t{k} WINDOW p AS (PARTITION BY node)),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN wx >= wy AND wx >= wz THEN gx WHEN wy >= wz THEN gy ELSE gz END, pos) - 1 AS rk FROM w{k}),
t{k + 1} AS (SELECT tri_idx, gx, gy, gz, lx, hx, ly, hy, lz, hz, node * 2 + (rk >= size // 2)::BIGINT AS node, rk AS pos, CASE WHEN rk >= size // 2 THEN size - size // 2 ELSE size // 2 END AS size FROM r{k})"""
    return out


@query("O01_index_tree", f"WITH {_tree_sql(3, 512)} SELECT tri_idx, node FROM t3")
def _(spark, d):
    return index.tree(wavy(spark), 64).select("tri_idx", "node")


@query("A11_A12_refitted_boxes", f"WITH {_tree_sql(3, 512)}, a AS (SELECT tri_idx, lx, hx, ly, hy, lz, hz, unnest([node, node // 2, node // 4, node // 8]) AS node FROM t3) SELECT node, count(*) AS triangles, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {c}" for f, c in [("min", f"l{k}") for k in "xyz"] + [("max", f"h{k}") for k in "xyz"]) + " FROM a GROUP BY node")
def _(spark, d):
    return told(index.refitted(index.tree(wavy(spark), 64), wavy(spark)), "node", "triangles", "lx", "ly", "lz", "hx", "hy", "hz")


@query("N022_index_statistics", "SELECT 8::BIGINT AS leaf_count, 15::BIGINT AS node_count, 3::BIGINT AS max_depth")
def _(spark, d):
    return told(index.statistics(index.tree(wavy(spark), 64)), "leaf_count", "node_count", "max_depth")


@query("X04_chunks", "SELECT c AS chunk, c * 256 AS first, least(c * 256 + 256, n) AS last FROM (SELECT count(*) AS n FROM events), LATERAL (SELECT unnest(range((n + 255) // 256)) AS c)")
def _(spark, d):
    return index.chunks(spark, spark.read.parquet(f"{d}/events.parquet").count())


@query("A13_A14_X02_chunk_totals", "SELECT event_id // 256 AS chunk, count(*) AS n, max(user_id) AS most, sum(event_id)::BIGINT AS total FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return index.chunked(e, "event_id", 256, F.count("*").alias("n"), F.max("user_id").alias("most"), F.sum("event_id").alias("total"))


# Frames of an animated surface.

_FRAMES = "fr AS (SELECT user_id AS sequence_id, event_id AS frame_idx, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 17 // 7 END AS topology, user_id % 5 <> 0 AS collider FROM events)"


@query("T16_T19_update_outcomes", f"WITH {_FRAMES}, b AS (SELECT *, last_value(topology IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fr), k AS (SELECT *, CASE WHEN topology IS NULL THEN 'invalid_surface' WHEN before IS NULL THEN 'initialized' WHEN topology = before THEN 'updated' END AS same FROM b) SELECT sequence_id, frame_idx, coalesce(same, 'resampled_topology') AS sampler, CASE WHEN NOT collider THEN 'disabled' ELSE coalesce(same, 'changed_topology') END AS collider, coalesce(topology = before, false) AS refit FROM k")
def _(spark, d):
    i = F.col("event_id")
    frames = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("sequence_id"), i.alias("frame_idx"), F.when(i % 13 == 0, None).otherwise(F.floor(i % 17 / 7)).alias("topology"), (F.col("user_id") % 5 != 0).alias("collider"))
    return runtime.update_outcomes(frames)


@query("T16_T18_surface_sequence", "SELECT * FROM (VALUES (0::BIGINT, 'initialized', 'initialized', false), (1, 'updated', 'updated', true), (2, 'resampled_topology', 'changed_topology', false), (3, 'updated', 'updated', true)) t(frame_idx, sampler, collider, refit)")
def _(spark, d):
    rows = None
    for k, s in enumerate((wavy(spark), surfaces.wavy_grid(spark, N, 0.5), wavy(spark, 8), surfaces.wavy_grid(spark, 8, 0.25))):
        one = geometry.topology_key(s).select(F.lit(0).alias("sequence_id"), F.lit(k).cast("bigint").alias("frame_idx"), F.concat_ws("/", "vertex_count", "triangle_count", "index_hash").alias("topology"), F.lit(True).alias("collider"))
        rows = one if rows is None else rows.union(one)
    return runtime.update_outcomes(rows).drop("sequence_id")


@query("T20_refresh_plan", "WITH f AS (SELECT event_id AS frame_idx, CASE event_id % 4 WHEN 0 THEN 'mesh-distance' WHEN 1 THEN 'none' WHEN 2 THEN 'sdf-field' ELSE 'adf-field' END AS source, user_id % 5 + 1 AS step FROM events) SELECT frame_idx, CASE WHEN source = 'none' THEN 'disabled' ELSE 'ready' END AS status, CASE WHEN source = 'none' THEN 'disabled' WHEN frame_idx % step = 0 THEN 'fresh' ELSE 'reused' END AS refresh, source IN ('sdf-field', 'adf-field') OR (source = 'mesh-distance' AND frame_idx % step = 0) AS forced FROM f")
def _(spark, d):
    frames = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("frame_idx"), runtime.named(F.col("event_id") % 4, runtime.SOURCES).alias("source"), (F.col("user_id") % 5 + 1).alias("interval"))
    return runtime.refresh_plan(frames).select("frame_idx", "status", "refresh", "forced")


@query("F48_markers", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'mesh-distance' WHEN 1 THEN 'none' WHEN 2 THEN 'sdf-field' WHEN 3 THEN 'adf-field' END AS marker FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", runtime.named(F.col("event_id") % 5, runtime.SOURCES).alias("marker"))


@query("F47_codes", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'baseline' WHEN 1 THEN 'transverse_cut_wound' WHEN 2 THEN 'gap_block' WHEN 3 THEN 'transient_memory' WHEN 4 THEN 'transient_no_memory_control' END AS scenario, CASE event_id % 8 WHEN 1 THEN 'tail' WHEN 2 THEN 'postpharyngeal' WHEN 3 THEN 'pharyngeal' WHEN 4 THEN 'prepharyngeal' WHEN 5 THEN 'head' END AS region FROM events")
def _(spark, d):
    from .operators import scenario

    return spark.read.parquet(f"{d}/events.parquet").select("event_id", runtime.named(F.col("event_id") % 7, scenario.SCENARIOS).alias("scenario"), runtime.named(F.col("event_id") % 8, scenario.REGIONS, 1).alias("region"))


@query("T21_refreshed_distances", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT point_idx AS particle_idx, round(sqrt(dd), 6) + 0.0 AS distance, tests FROM near")
def _(spark, d):
    return told(runtime.refreshed_distances(surfaces.particles(spark, d), wavy(spark)), "particle_idx", "distance", "tests")


@query("A18_A20_refresh_counts", "SELECT count(*) AS particles, count(*) AS refreshed_samples, count(*) * 512 AS triangle_tests FROM embeddings")
def _(spark, d):
    return told(runtime.refresh_counts(runtime.refreshed_distances(surfaces.particles(spark, d), wavy(spark))), "particles", "refreshed_samples", "triangle_tests")


# A force whose samples fail for some particles.
_FORCE = "fo AS (SELECT i, x, y, z, CASE WHEN i % 3 <> 1 THEN sqrt(x*x+y*y+z*z) END AS distance FROM p)"


def _force(p):
    n = Vec.of().length()
    return p.filter("particle_idx % 3 <> 1").select("particle_idx", n.alias("distance"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))


@query("O04_force_probe", f"WITH {_PART}, {_FORCE}, s AS (SELECT * FROM fo WHERE distance IS NOT NULL ORDER BY i LIMIT 25), e AS (SELECT count(*) AS rejected FROM fo WHERE distance IS NULL AND i < (SELECT max(i) FROM s)) SELECT i AS particle_idx, round(distance, 6) + 0.0 AS distance, 0.0065::DOUBLE AS target_distance, " + ", ".join(f"round({k}/distance * -(distance - 0.0065) * 19, 6) + 0.0 AS a{k}" for k in "xyz") + ", rejected FROM s, e")
def _(spark, d):
    p = surfaces.particles(spark, d)
    return told(runtime.force_probe(p, _force(p), 25), "particle_idx", "distance", "target_distance", "ax", "ay", "az", "rejected")


def _step_sql(table: str, out: str, near: bool, dt: str, cloud: float = 0.3, radius: float = 0.05) -> str:
    pull = {k: f"CASE WHEN distance IS NULL THEN 0 ELSE o{k} * -(distance - greatest(0.01 * 0.65, 0.0008)) * 19.0 END" for k in "xyz"} if near else dict.fromkeys("xyz", "0")
    moves = "im <> 0 AND distance IS NOT NULL" if near else "im <> 0"
    speed = 1.9 * radius
    return f"""{out}a AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM {table}),
{out}b AS (SELECT *, {', '.join(f"(v{k} + ({pull[k]} + CASE WHEN n > 1.12*{cloud} THEN {k}/n * -(n - {cloud}) * 7.0 ELSE 0 END) * ({dt})) * (1 - 1.55 * ({dt})) AS w{k}" for k in 'xyz')} FROM {out}a),
{out}c AS (SELECT *, CASE WHEN sqrt(wx*wx+wy*wy+wz*wz) > {speed} THEN {speed}/sqrt(wx*wx+wy*wy+wz*wz) ELSE 1 END AS q FROM {out}b),
{out} AS (SELECT i, im, {', '.join(f"CASE WHEN {moves} THEN {k} + w{k}*q*({dt}) ELSE {k} END AS {k}, CASE WHEN {moves} THEN w{k}*q ELSE v{k} END AS v{k}" for k in 'xyz')} FROM {out}c)"""


@query("T04_T05_forced_step", f"WITH {_PART}, {_FORCE}, j AS (SELECT p.*, distance, p.x/distance AS ox, p.y/distance AS oy, p.z/distance AS oz FROM p JOIN fo USING (i)), {_step_sql('j', 'o', True, '1/45.0::DOUBLE')} SELECT i AS particle_idx, {r6('x', 'y', 'z', 'vx', 'vy', 'vz')} FROM o")
def _(spark, d):
    p = surfaces.particles(spark, d)
    return told(runtime.unforced_step(p, 1 / 45, (0, 0, 0), 0.3, 0.05, _force(p)), "particle_idx", "x", "y", "z", "vx", "vy", "vz")


@query("T20_unforced_frames", f"WITH {_PART}, {_step_sql('p', 'o', False, '1/45.0::DOUBLE')}, {_step_sql('o', 's', False, '1/45.0::DOUBLE')}, {_step_sql('s', 't', False, '1/45.0::DOUBLE')} SELECT i AS particle_idx, {r6('x', 'y', 'z', 'vx', 'vy', 'vz')} FROM t")
def _(spark, d):
    return told(runtime.stepped(surfaces.particles(spark, d), wavy(spark), "none", 1, 3, 1 / 45, (0, 0, 0), 0.3, 0.05), "particle_idx", "x", "y", "z", "vx", "vy", "vz")


_NEAR = f"{wavy_sql()}, {points_sql()}, {closest_sql('pts').replace('near AS', 'near0 AS')}, d6 AS (SELECT point_idx, tri_idx, gx, gy, gz, gx*gx+gy*gy+gz*gz AS dd, nx, ny, nz FROM d4), best AS (SELECT *, row_number() OVER (PARTITION BY point_idx ORDER BY dd, tri_idx) AS rk FROM d6), nr AS (SELECT point_idx, sqrt(dd) AS distance, CASE WHEN sqrt(dd) > 1e-6 THEN gx/sqrt(dd) ELSE nx/sqrt(nx*nx+ny*ny+nz*nz) END AS ox, CASE WHEN sqrt(dd) > 1e-6 THEN gy/sqrt(dd) ELSE ny/sqrt(nx*nx+ny*ny+nz*nz) END AS oy, CASE WHEN sqrt(dd) > 1e-6 THEN gz/sqrt(dd) ELSE nz/sqrt(nx*nx+ny*ny+nz*nz) END AS oz FROM best WHERE rk = 1)"


@query("F50_outward_samples", f"WITH {_NEAR} SELECT point_idx, round(distance, 6) + 0.0 AS distance, " + ", ".join(f"round(o{k}, 4) + 0.0 AS o{k}" for k in "xyz") + " FROM nr")
def _(spark, d):
    out = distance.outward(distance.closest_surface(surfaces.points(spark, d), wavy(spark)))
    return out.select("point_idx", rounded(F.col("distance")).alias("distance"), *[rounded(F.col(f"o{k}"), 4).alias(f"o{k}") for k in "xyz"])


@query("T20_mesh_frames", f"WITH {_PART}, {_NEAR}, j AS (SELECT p.*, distance, ox, oy, oz FROM p JOIN nr ON point_idx = i), {_step_sql('j', 'o', True, '1/45.0::DOUBLE')}, {_step_sql('o', 's', False, '1/45.0::DOUBLE')} SELECT i AS particle_idx, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))} FROM s")
def _(spark, d):
    out = runtime.stepped(surfaces.particles(spark, d), wavy(spark), "mesh-distance", 2, 2, 1 / 45, (0, 0, 0), 0.3, 0.05)
    return out.select("particle_idx", *[rounded(F.col(c), 5).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query("T20_grid_frames")
def _(spark, d):
    return told(runtime.stepped(surfaces.particles(spark, d), wavy(spark, 8), "sdf-field", 1, 1, 1 / 45, (0, 0, 0), 0.3, 0.05, sdf.build(wavy(spark, 8), 0.1)), "particle_idx", "x", "y", "z")


@query("A39_runtime_status", "SELECT 289::BIGINT AS vertex_count, 512::BIGINT AS triangle_count, count(*) AS particle_count, count(*) AS distance_samples, 'mesh-distance' AS source, 1::BIGINT AS interval FROM embeddings")
def _(spark, d):
    p = surfaces.particles(spark, d)
    return told(runtime.status(wavy(spark), p, runtime.refreshed_distances(p, wavy(spark))), "vertex_count", "triangle_count", "particle_count", "distance_samples", "source", "interval")


@query("T24_steps_of_calls", "SELECT event_id, least(greatest(event_id % 23 - 5, 1), 8) AS steps FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", runtime.steps_of_call(F.col("event_id") % 23 - 5).alias("steps"))


@query("J34_nearest_nodes", f"WITH {points_sql()} SELECT point_idx AS node_idx, round((x-0.1)*(x-0.1)+(y-0.2)*(y-0.2)+z*z, 6) + 0.0 AS d2 FROM pts ORDER BY (x-0.1)*(x-0.1)+(y-0.2)*(y-0.2)+z*z, point_idx LIMIT 40")
def _(spark, d):
    return told(runtime.nearest_nodes(_nodes(spark, d).withColumnRenamed("idx", "node_idx"), (0.1, 0.2, 0.0), 40), "node_idx", "d2")


_INFLATED = f"""WITH {wavy_sql(name='o')}, part AS (SELECT a AS v, nx, ny, nz FROM onrm UNION ALL SELECT b, nx, ny, nz FROM onrm UNION ALL SELECT c, nx, ny, nz FROM onrm), s AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM part GROUP BY v),
vert AS (SELECT vertex_idx, x+0.02*nx/sqrt(nx*nx+ny*ny+nz*nz) AS x, y+0.02*ny/sqrt(nx*nx+ny*ny+nz*nz) AS y, z+0.02*nz/sqrt(nx*nx+ny*ny+nz*nz) AS z FROM overt JOIN s ON v = vertex_idx),
faces AS (SELECT t.tri_idx, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS "by", q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM otri t JOIN vert p ON p.vertex_idx = t.a JOIN vert q ON q.vertex_idx = t.b JOIN vert r ON r.vertex_idx = t.c),
area AS (SELECT *, 0::DOUBLE AS nx, 0::DOUBLE AS ny, 0::DOUBLE AS nz FROM faces), {points_sql()}, {closest_sql('pts')}"""


@query("J35_collider_closest_place", f"{_INFLATED} SELECT point_idx, round(sqrt(dd), 6) + 0.0 AS distance FROM near")
def _(spark, d):
    return told(distance.closest_surface(surfaces.points(spark, d), geometry.inflated(wavy(spark), 0.02)), "point_idx", "distance")


@query("A41_running_bounds", "SELECT user_id AS sequence_id, event_id AS frame_idx, " + ", ".join(f"{f}(event_id % {m} * {k}) OVER w AS {f}_{c}" for c, m, k in (("x", 17, 1), ("y", 19, 2), ("z", 23, 3)) for f in ("min", "max")) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, d):
    i = F.col("event_id")
    v = {c: i % m * k for c, m, k in (("x", 17, 1), ("y", 19, 2), ("z", 23, 3))}
    return runtime.running_bounds(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("sequence_id"), i.alias("frame_idx"), *[c.alias(f"{m}_{k}") for m in ("min", "max") for k, c in v.items()]))


@query("J28_public_links", "WITH f AS (SELECT o_orderkey AS f, o_orderpriority AS k, 'p' || o_orderkey % 5 AS p, 'h' AS h FROM orders), i AS (SELECT o_orderkey AS f, o_orderpriority AS k, 'p' || o_orderkey % 5 AS p, CASE WHEN o_orderkey % 11 = 0 THEN 'g' ELSE 'h' END AS h FROM orders WHERE o_orderkey % 7 <> 0) SELECT f.f AS fixture_id, f.k AS kind, CASE WHEN i.f IS NULL THEN 'link.missing' WHEN f.p <> i.p OR f.h <> i.h THEN 'link.mismatch' END AS rejection FROM f LEFT JOIN i ON i.f = f.f AND i.k = f.k")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("fixture_id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("p"), (F.col("o_orderkey") % 5).cast("string")).alias("path"), F.lit("h").alias("sha256"))
    given = o.filter("fixture_id % 7 <> 0").withColumn("sha256", F.when(F.col("fixture_id") % 11 == 0, "g").otherwise("h"))
    return runtime.public_links(o, given)


@query("F19_cell_axis_ranges", "WITH c AS (SELECT event_id, (event_id % 29 - 4) * 0.1::DOUBLE AS cell, (event_id % 5 + 1) * 0.15::DOUBLE AS extent FROM events), e AS (SELECT event_id, (cell + extent + 0.03::DOUBLE) / 0.1::DOUBLE - 0.5::DOUBLE AS b, (cell + 0.03::DOUBLE) / 0.1::DOUBLE - 0.5::DOUBLE AS a FROM c), f AS (SELECT event_id, CASE WHEN a <= 0 THEN 0 ELSE least(ceil(a), 20) END AS a, CASE WHEN b <= 0 THEN 0 ELSE least(ceil(b), 20) END AS b FROM e) SELECT event_id, least(a, b)::BIGINT AS first, b::BIGINT AS last FROM f")
def _(spark, d):
    i = F.col("event_id")
    first, last = runtime.axis_range(F.lit(-0.03), F.lit(0.1), F.lit(20), (i % 29 - 4) * F.lit(0.1), (i % 5 + 1) * F.lit(0.15))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


# Debug frames and summaries.

_LAYERS = "ly AS (SELECT layer, vec_id AS node_idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[8 + layer]::DOUBLE AS value FROM embeddings, range(1, 4) r(layer))"


def _layers(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_idx"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("layer"))
    return e.select(F.col("layer").cast("bigint").alias("layer"), "node_idx", F.element_at("embedding", F.col("layer") + 8).cast("double").alias("value"))


@query("S16_field_frame", f"WITH {_LAYERS} SELECT layer, node_idx, {r6('x', 'y', 'z', 'value')}, round(min(value) OVER p, 6) + 0.0 AS least, round(max(value) OVER p, 6) + 0.0 AS most FROM ly WINDOW p AS (PARTITION BY layer)")
def _(spark, d):
    return told(runtime.debug_layers(_nodes(spark, d).withColumnRenamed("idx", "node_idx"), _layers(spark, d)), "layer", "node_idx", "x", "y", "z", "value", "least", "most")


@query("S17_circuit_frame", "WITH l AS (SELECT vec_id AS node_idx, unnest(['voltage', 'memory', 'readout']) AS layer, unnest([0.18*embedding[1]::DOUBLE + 0.1*embedding[2]::DOUBLE, 0.0, 0.0]) AS value FROM embeddings) SELECT layer, node_idx, round(value, 6) + 0.0 AS value, round(min(value) OVER p, 6) + 0.0 AS least, round(max(value) OVER p, 6) + 0.0 AS most FROM l WINDOW p AS (PARTITION BY layer)")
def _(spark, d):
    return told(runtime.circuit_layers(_circuit(spark, d)[0]), "layer", "node_idx", "value", "least", "most")


@query("T25_zero_step_summary", f"WITH {_LAYERS} SELECT (SELECT count(DISTINCT layer) FROM ly) AS scalar_fields, (SELECT count(*) FROM embeddings) AS nodes, (SELECT round(min(value), 6) + 0.0 FROM ly) AS scalar_min, (SELECT round(max(value), 6) + 0.0 FROM ly) AS scalar_max, (SELECT round(max(sqrt(embedding[11]::DOUBLE*embedding[11]+embedding[12]::DOUBLE*embedding[12]+embedding[13]::DOUBLE*embedding[13])), 5) + 0.0 FROM embeddings) AS max_vector_length, (SELECT count(*) FROM events WHERE value IS NOT NULL) AS perturbations, 0::BIGINT AS steps")
def _(spark, d):
    from .catalog import _schedule, _vectors

    out = runtime.zero_step_summary(_layers(spark, d).withColumnRenamed("layer", "field_id"), _vectors(spark, d), _schedule(spark, d))
    return told(out.withColumn("max_vector_length", rounded(F.col("max_vector_length"), 5)), "scalar_fields", "nodes", "scalar_min", "scalar_max", "max_vector_length", "perturbations", "steps")


@query("A38_circuit_status", f"WITH {_REGION}, st AS (SELECT node_idx, region, (node_idx % 13) / 10.0::DOUBLE - 0.5 AS v, (node_idx % 7) / 10.0::DOUBLE AS m, (node_idx % 5) / 10.0::DOUBLE AS r FROM rg) SELECT count(*) AS nodes, round(avg(m) FILTER (region <= 2), 6) + 0.0 AS posterior_memory, round(avg(r) FILTER (region = 5), 6) + 0.0 AS head_readout, round(avg(r) FILTER (region = 1), 6) + 0.0 AS tail_readout, round(max(v), 6) + 0.0 AS max_voltage, 4::BIGINT AS terms, 3::BIGINT AS active_terms FROM st")
def _(spark, d):
    mapped, edges = _body(spark)
    i = F.col("node_idx")
    state = mapped.select("node_idx", ((i % 13) / 10 - 0.5).alias("voltage"), ((i % 7) / 10).alias("memory"), ((i % 5) / 10).alias("readout"))
    return told(runtime.circuit_status(state, edges, _circuit(spark, d)[2], mapped, 24, 1 / 60), "nodes", "posterior_memory", "head_readout", "tail_readout", "max_voltage", "terms", "active_terms")


# Packed exports.


@query("S20_S24_S26_packed_nodes", f"WITH {_PART} SELECT i AS idx, round(list_sum([x, y, z, coalesce(CASE WHEN im = 0 THEN NULL ELSE im END, 0)]), 6) + 0.0 AS total, 4::BIGINT AS n, round(CASE WHEN im = 0 THEN 0 ELSE im END, 6) + 0.0 AS last FROM p")
def _(spark, d):
    p = surfaces.particles(spark, d).withColumn("mass", F.when(F.col("inverse_mass") != 0, F.col("inverse_mass")))
    packed = coordinates.packed_nodes(p, "particle_idx", "x", "y", "z", "mass")
    return told(packed.select("idx", F.aggregate("packed", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("packed").alias("n"), F.element_at("packed", 4).alias("last")), "idx", "total", "n", "last")


@query("S22_S23_packed_edges", "WITH e AS (SELECT event_id AS i, user_id AS f, user_id % 7 AS t, event_id % 2 + 1 AS tier, CASE WHEN event_id % 3 = 0 THEN 0.07 END AS threshold FROM events) SELECT i AS idx, f::DOUBLE AS a, t::DOUBLE AS b, tier::DOUBLE AS tier, CASE WHEN threshold IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS gated, coalesce(threshold, 0.0)::DOUBLE AS threshold FROM e")
def _(spark, d):
    i = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(i, "user_id", (F.col("user_id") % 7).alias("to_node"), (i % 2 + 1).alias("tier"), F.when(i % 3 == 0, 0.07).alias("threshold"))
    packed = coordinates.packed_nodes(e.withColumn("gated", F.col("threshold").isNotNull().cast("int")), "event_id", "user_id", "to_node", "tier", "gated", "threshold")
    return packed.select("idx", *[F.get("packed", k).alias(n) for k, n in enumerate(("a", "b", "tier", "gated", "threshold"))])


@query("S27_packed_closest_samples", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT point_idx, 12::BIGINT AS n, round(sqrt(dd), 6) + 0.0 AS distance, 1.0::DOUBLE AS hit, tests::DOUBLE AS tests FROM near UNION ALL SELECT -1, 1, NULL, 0.0, NULL")
def _(spark, d):
    asked = surfaces.points(spark, d).union(spark.createDataFrame([(-1, math.nan, 0.0, 0.0)], "point_idx long, x double, y double, z double"))
    packed = coordinates.packed_samples(asked, distance.closest_surface(asked, wavy(spark)))
    return told(packed.select("point_idx", F.size("packed").alias("n"), F.get("packed", 7).alias("distance"), F.get("packed", 0).alias("hit"), F.get("packed", 11).alias("tests")), "point_idx", "n", "distance", "hit", "tests")


# Files.


def _glbs(spark, d, bones: bool = False):
    """A file for each nation: a fan of key + 3 points, every fifth one damaged in its own way."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k in keys:
                points = [(0.1 * k, 0.0, 0.0)] + [(0.25 * i, 0.5 * i * i - k, 1.0) for i in range(k + 2)]
                faces = [(0, i + 1, i + 2) for i in range(k + 1)]
                if bones:
                    half = 0.5
                    rig = {"joints": [(0, 1, 0, 0)] * len(points), "weights": [(1, 0, 0, 0) if i % 2 else (0.5, 0.25, 0, 0) for i in range(len(points))], "nodes": [{}, {"translation": [0, 0, 1]}], "keys": ([0, 1], [(0, 0, 0, 1), (0, 0, math.sin(half), math.cos(half))])}
                    out.append(glb.encoded(points, faces, bones=rig))
                    continue
                raw = glb.encoded(points, None if k % 5 == 2 and len(points) % 3 == 0 else faces if k % 5 != 1 else [(0, 1, 99)], mode=1 if k % 5 == 3 else 4)
                out.append(raw[:-4] if k % 5 == 4 else raw)
            yield pa.RecordBatch.from_arrays([pa.array([f"n{k}.glb" for k in keys]), pa.array(out, pa.binary())], ["path", "content"])

    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").mapInArrow(run, "path string, content binary")


_FILE = "f AS (SELECT n_nationkey AS k, 'n' || n_nationkey || '.glb' AS path FROM nation)"
_POINTS = "pt AS (SELECT k, path, 0 AS i, 0.1 * k AS x, 0.0 AS y, 0.0 AS z FROM f UNION ALL SELECT k, path, j + 1, 0.25 * j, 0.5 * j * j - k, 1.0 FROM f, LATERAL (SELECT unnest(range(k + 2)) AS j))"


@query("S01_S02_glb_summaries", f"WITH {_FILE}, {_POINTS}, s AS (SELECT path, k, count(*) AS vertices, CASE WHEN k % 5 = 2 AND (k + 3) % 3 = 0 THEN (k + 3) // 3 ELSE k + 1 END AS triangles, min(x) AS min_x, max(y) AS max_y FROM pt GROUP BY path, k) SELECT path, CASE WHEN k % 5 = 1 THEN 'glb.index_range' WHEN k % 5 = 4 THEN 'glb.length' END AS rejection, CASE WHEN k % 5 IN (0, 2) THEN vertices END AS vertices, CASE WHEN k % 5 IN (0, 2) THEN triangles END::BIGINT AS triangles, CASE WHEN k % 5 IN (0, 2) THEN round(min_x, 5) + 0.0 END AS min_x, CASE WHEN k % 5 IN (0, 2) THEN round(max_y, 5) + 0.0 END AS max_y FROM s WHERE k % 5 <> 3 UNION ALL SELECT path, 'glb.no_surface', NULL, NULL, NULL, NULL FROM f WHERE k % 5 = 3")
def _(spark, d):
    out = glb.summaries(_glbs(spark, d)).select("path", "rejection", "vertices", "triangles", rounded(F.col("min_x"), 5).alias("min_x"), rounded(F.col("max_y"), 5).alias("max_y"))
    return out


@query("S03_glb_vertices", f"WITH {_FILE}, {_POINTS} SELECT path || '#0.0' AS surface_id, i AS vertex_idx, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM pt WHERE k % 5 IN (0, 2)")
def _(spark, d):
    return glb.vertices(_glbs(spark, d)).select("surface_id", "vertex_idx", *[rounded(F.col(c), 5).alias(c) for c in "xyz"])


@query("S04_glb_triangles", f"WITH {_FILE} SELECT path || '#0.0' AS surface_id, i AS tri_idx, CASE WHEN t THEN 3 * i ELSE 0 END AS a, CASE WHEN t THEN 3 * i + 1 ELSE i + 1 END AS b, CASE WHEN t THEN 3 * i + 2 ELSE i + 2 END AS c FROM (SELECT *, k % 5 = 2 AND k % 3 = 0 AS t FROM f WHERE k % 5 IN (0, 2)), LATERAL (SELECT unnest(range(CASE WHEN t THEN (k + 3) // 3 ELSE k + 1 END)) AS i)")
def _(spark, d):
    return glb.faces(_glbs(spark, d))


@query("S05_F34_glb_sequence", f"WITH {_FILE}, {_POINTS}, pf AS (SELECT path, i, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z FROM pt), q AS (SELECT j AS frame, j / 4.0::DOUBLE AS t, (j / 4.0::DOUBLE) * sin(0.5::DOUBLE)::FLOAT::DOUBLE AS s, 1 + (j / 4.0::DOUBLE) * (cos(0.5::DOUBLE)::FLOAT::DOUBLE - 1) AS c FROM range(4) r(j)), u AS (SELECT frame, t, 2 * (s/sqrt(s*s+c*c)) * (c/sqrt(s*s+c*c)) AS sn, 1 - 2 * (s/sqrt(s*s+c*c)) * (s/sqrt(s*s+c*c)) AS cs FROM q), m AS (SELECT path, frame, t, i, x, y, z, x*cs - y*sn AS rx, x*sn + y*cs AS ry FROM pf, u) SELECT path, frame, round(t, 5) + 0.0 AS t, i AS vertex_idx, round(CASE WHEN i % 2 = 1 THEN rx ELSE (0.5*rx + 0.25*x)/0.75 END, 4) + 0.0 AS x, round(CASE WHEN i % 2 = 1 THEN ry ELSE (0.5*ry + 0.25*y)/0.75 END, 4) + 0.0 AS y, round(CASE WHEN i % 2 = 1 THEN z ELSE (0.5*z + 0.25*(z+1))/0.75 END, 4) + 0.0 AS z FROM m")
def _(spark, d):
    out = glb.sequence(_glbs(spark, d, True), 4)
    return out.select("path", "frame", rounded(F.col("t"), 5).alias("t"), "vertex_idx", *[rounded(F.col(c), 4).alias(c) for c in "xyz"])


@query("F39_normalised_bodies", f"WITH {_FILE}, {_POINTS}, g AS (SELECT * FROM pt WHERE k % 5 IN (0, 2)), b AS (SELECT path, max(x)-min(x) AS sx, max(y)-min(y) AS sy, max(z)-min(z) AS sz FROM g GROUP BY path), a AS (SELECT g.*, greatest(sx, sy, sz) AS span, CASE WHEN sx >= sy AND sx >= sz THEN 0 WHEN sy >= sz THEN 1 ELSE 2 END AS axis FROM g JOIN b USING (path)), t AS (SELECT path, i, 1.65/span*(CASE WHEN axis = 0 THEN z ELSE x END) AS x, 1.65/span*(CASE WHEN axis = 1 THEN -z ELSE y END) AS y, 1.65/span*(CASE axis WHEN 0 THEN -x WHEN 1 THEN y ELSE z END) AS z FROM a), c AS (SELECT path, (min(x)+max(x))/2 AS x, (min(y)+max(y))/2 AS y, (min(z)+max(z))/2 AS z FROM t GROUP BY path) SELECT path || '#0.0' AS surface_id, i AS vertex_idx, round(t.x-c.x, 4) + 0.0 AS x, round(t.y-c.y-0.09, 4) + 0.0 AS y, round(t.z-c.z, 4) + 0.0 AS z FROM t JOIN c USING (path)")
def _(spark, d):
    out = glb.normalised(glb.vertices(_glbs(spark, d)))
    return out.select("surface_id", "vertex_idx", *[rounded(F.col(c), 4).alias(c) for c in "xyz"])


@query("S06_S07_packed_surfaces", f"WITH {_FILE}, {_POINTS} SELECT path || '#0.0' AS surface_id, i AS vertex_idx, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM pt WHERE k % 5 IN (0, 2)")
def _(spark, d):
    files = _glbs(spark, d)
    back = glb.unpacked_surface(glb.packed_surface(glb.vertices(files), glb.faces(files)))
    return back.select("surface_id", "vertex_idx", *[rounded(F.col(c), 5).alias(c) for c in "xyz"])


@query("S08_S09_artifact_check", "SELECT event_type AS artifact, CASE WHEN event_type = 'click' THEN 'artifact.text_differs' WHEN event_type = 'view' THEN 'artifact.missing' END AS rejection FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    built = artifacts.documents(e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")), "event_type")
    stored = built.filter("artifact <> 'view'").withColumn("text", F.when(F.col("artifact") == "click", F.concat("text", F.lit("x"))).otherwise(F.concat("text", F.lit("\n \n"))))
    return artifacts.checked(built, stored)


@query("S28_json_lines", "SELECT event_id, '{\"schema\":\"sweep.v1\",\"workload\":\"' || event_type || '\",\"particles\":' || (event_id % 512)::VARCHAR || ',\"frames\":' || (user_id % 30 + 1)::VARCHAR || '}' AS line FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", artifacts.json_line(F.lit("sweep.v1").alias("schema"), F.col("event_type").alias("workload"), (F.col("event_id") % 512).alias("particles"), (F.col("user_id") % 30 + 1).alias("frames")).alias("line"))


@query("S29_schema_catalog", "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{n}', {len(t)}::BIGINT)" for k, (n, t) in enumerate(artifacts.SCHEMAS.items())) + ") t(ord, schema_id, fields)")
def _(spark, d):
    return artifacts.catalog(spark).select("ord", "schema_id", "fields")


@query("S30_forbidden_terms", "SELECT page_id, term FROM pages, (SELECT unnest(['<script', 'password', 'lorem']) AS term) WHERE contains(lower(coalesce(html, '')), term)")
def _(spark, d):
    return artifacts.forbidden(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), "page_id", "html", ("<script", "password", "lorem"))


# Functions by themselves.


@query("F05_box_distance", f"WITH {points_sql()} SELECT point_idx, round(pow(greatest(-0.1-x, x-0.1, 0), 2) + pow(greatest(-0.2-y, y-0.05, 0), 2) + pow(greatest(0-z, z-0.3, 0), 2), 6) + 0.0 AS d2 FROM pts")
def _(spark, d):
    return told(surfaces.points(spark, d).select("point_idx", vectors.box_distance_squared(Vec.of(), Vec.lit(-0.1, -0.2, 0), Vec.lit(0.1, 0.05, 0.3)).alias("d2")), "point_idx", "d2")


def _u32(expression: str) -> str:
    return f"(({expression}) % 4294967296)::BIGINT"


def _hash01_sql(x: str) -> str:
    for shift, k in ((16, hashing.MIX_A), (15, hashing.MIX_B)):
        x = _u32(f"xor(({x})::BIGINT, ({x})::BIGINT >> {shift})::HUGEINT * {k}")
    return f"((xor({x}, {x} >> 16)) & 16777215) / 16777215.0::DOUBLE"


def _quasi_sql(local: str, tri: str, seed: int, axis: int) -> str:
    start = (seed & 0xFFFFFFFF) ^ (seed >> 32 & 0xFFFFFFFF) ^ ((axis * hashing.AXIS) & 0xFFFFFFFF)
    key = f"xor({start}::BIGINT, {_u32(f'({tri})::HUGEINT * {hashing.TRIANGLE}')})"
    x = f"(({local}) + 0.5::DOUBLE) * {0.618034 if axis == 0 else 0.7548777}::DOUBLE + {_hash01_sql(key)}"
    return f"least(greatest(({x}) - floor({x}), 1e-6::DOUBLE), 0.999999::DOUBLE)"


@query("F08_F09_hashed_numbers", f"SELECT event_id, round({_hash01_sql('event_id')}, 6) + 0.0 AS h, round({_quasi_sql('event_id % 50', 'user_id', 11337, 0)}, 6) + 0.0 AS q0, round({_quasi_sql('event_id % 50', 'user_id', 11337, 1)}, 6) + 0.0 AS q1 FROM events")
def _(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    return told(spark.read.parquet(f"{d}/events.parquet").select("event_id", hashing.hash01(i).alias("h"), hashing.quasirandom01(i % 50, u, 11337, 0).alias("q0"), hashing.quasirandom01(i % 50, u, 11337, 1).alias("q1")), "event_id", "h", "q0", "q1")


@query("F07_halton", "WITH RECURSIVE h AS (SELECT event_id, event_id % 997 + 1 AS n, 0::DOUBLE AS v, 1/3.0::DOUBLE AS f FROM events UNION ALL SELECT event_id, n // 3, v + f * (n % 3), f / 3 FROM h WHERE n > 0) SELECT event_id, round(v, 6) + 0.0 AS v FROM h WHERE n = 0")
def _(spark, d):
    return told(spark.read.parquet(f"{d}/events.parquet").select("event_id", hashing.halton01(F.col("event_id") % 997 + 1, 3).alias("v")), "event_id", "v")


_SAMPLES = f"""{wavy_sql()}, cum AS (SELECT tri_idx, sum(area) OVER (ORDER BY tri_idx) AS high FROM area WHERE area > 1e-9), s0 AS (SELECT i AS sample_idx, least((i + 0.5::DOUBLE) / 256 * (SELECT max(high) FROM cum), (SELECT max(high) FROM cum)) AS target FROM range(256) t(i)),
s1 AS (SELECT sample_idx, min(tri_idx) AS tri_idx FROM s0 JOIN cum ON high >= target GROUP BY sample_idx), s2 AS (SELECT *, row_number() OVER (PARTITION BY tri_idx ORDER BY sample_idx) - 1 AS local FROM s1),
s3 AS (SELECT *, sqrt({_quasi_sql('local', 'tri_idx', 11337, 0)}) AS r, {_quasi_sql('local', 'tri_idx', 11337, 1)} AS v FROM s2),
smp AS (SELECT sample_idx, s3.tri_idx, 1-r AS b0, r*(1-v) AS b1, r*v AS b2, ax*(1-r)+bx*r*(1-v)+cx*r*v AS x, ay*(1-r)+"by"*r*(1-v)+cy*r*v AS y, az*(1-r)+bz*r*(1-v)+cz*r*v AS z, nx/(2*area) AS nx, ny/(2*area) AS ny, nz/(2*area) AS nz FROM s3 JOIN area USING (tri_idx))"""


@query("F51_W02_surface_samples", f"WITH {_SAMPLES} SELECT sample_idx, tri_idx, {r6('x', 'y', 'z', 'b0', 'b1', 'b2', 'nx', 'ny', 'nz')} FROM smp")
def _(spark, d):
    return told(sampling.samples(wavy(spark), 256), "sample_idx", "tri_idx", "x", "y", "z", "b0", "b1", "b2", "nx", "ny", "nz")


_MOVED = wavy_sql(name="m").replace("sin((i % 17) / CAST(16 AS DOUBLE) * 2 * pi())", "sin((i % 17) / CAST(16 AS DOUBLE) * 2 * pi() + 0.5::DOUBLE)")


@query("J37_F10_updated_samples", f"WITH {_SAMPLES}, {_MOVED} SELECT sample_idx, " + ", ".join(f"round(m.a{k}*b0+m.\"b{k}\"*b1+m.c{k}*b2, 6) + 0.0 AS {k}" for k in "xyz") + " FROM smp JOIN mfaces m USING (tri_idx)")
def _(spark, d):
    return told(coordinates.updated(sampling.samples(wavy(spark), 256), surfaces.wavy_grid(spark, N, 0.5)), "sample_idx", "x", "y", "z")


_AXES = f"""{_SAMPLES}, z0 AS (SELECT sample_idx, x AS px, y AS py, z AS pz, nx AS wx, ny AS wy, nz AS wz, CASE WHEN abs(ny) < 0.92 THEN 0 ELSE 1 END AS hx, CASE WHEN abs(ny) < 0.92 THEN 1 ELSE 0 END AS hy FROM smp),
z1 AS (SELECT *, hy*wz AS cx, -hx*wz AS cy, hx*wy-hy*wx AS cz FROM z0), z2 AS (SELECT *, cx/sqrt(cx*cx+cy*cy+cz*cz) AS ux, cy/sqrt(cx*cx+cy*cy+cz*cz) AS uy, cz/sqrt(cx*cx+cy*cy+cz*cz) AS uz FROM z1),
z3 AS (SELECT *, wy*uz-wz*uy AS vx, wz*ux-wx*uz AS vy, wx*uy-wy*ux AS vz FROM z2)"""


@query("F13_local_axes", f"WITH {_AXES} SELECT sample_idx, {', '.join(f'round({a}{k}, 5) + 0.0 AS {a}{k}' for a in 'uvw' for k in 'xyz')} FROM z3")
def _(spark, d):
    out = coordinates.frames(sampling.samples(wavy(spark), 256))
    return out.select("sample_idx", *[rounded(F.col(f"{a}{k}"), 5).alias(f"{a}{k}") for a in "uvw" for k in "xyz"])


@query("F14_F15_displaced_samples", f"WITH {_AXES}, k AS (SELECT 1/sqrt(0.25+0.0625+1) AS s) SELECT sample_idx, {', '.join(f'round(p{c} + 0.02*0.5*s*u{c} - 0.03*0.25*s*v{c} + 0.04*1*s*w{c}, 5) + 0.0 AS {c}' for c in 'xyz')} FROM z3, k")
def _(spark, d):
    out = coordinates.displaced(coordinates.frames(sampling.samples(wavy(spark), 256), (0.02, 0.03, 0.04)), Vec.lit(0.5, -0.25, 2.0))
    return out.select("sample_idx", *[rounded(F.col(k), 5).alias(k) for k in "xyz"])


@query("F37_joint_matrices", "WITH j AS (SELECT f AS frame, k AS joint, f*0.1*(k+1) AS a FROM range(3) t(f), range(4) s(k)) SELECT frame, joint, round(cos(a), 6) + 0.0 AS m00, round(-sin(a), 6) + 0.0 AS m01, round(sin(a), 6) + 0.0 AS m10, 1.0::DOUBLE AS m22, round(joint*0.1 - cos(a)*joint*0.1, 6) + 0.0 AS m03, round(frame*0.05 - sin(a)*joint*0.1, 6) + 0.0 AS m13 FROM j")
def _(spark, d):
    _, _, bind, poses = _rig(spark, d)
    return told(skinning.joint_matrices(bind, poses), "frame", "joint", "m00", "m01", "m10", "m22", "m03", "m13")


@query("F38_interpolated_rotations", "WITH q AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS t, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM events), m AS (SELECT event_id, t * sin(0.4::DOUBLE) AS z, 1 + t * (cos(0.4::DOUBLE) - 1) AS w FROM q) SELECT event_id, round(z/sqrt(z*z+w*w), 6) + 0.0 AS qz, round(w/sqrt(z*z+w*w), 6) + 0.0 AS qw FROM m")
def _(spark, d):
    i = F.col("event_id")
    sign = F.when(i % 2 == 0, 1.0).otherwise(-1.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    q = skinning.nlerp((zero, zero, zero, one), (zero, zero, sign * math.sin(0.4), sign * math.cos(0.4)), (i % 11) / 10)
    return told(spark.read.parquet(f"{d}/events.parquet").select("event_id", q[2].alias("qz"), q[3].alias("qw")), "event_id", "qz", "qw")


@query("J24_skinned_normals", "WITH w AS (SELECT vec_id AS v, vec_id*(s+1)%4 AS j, CASE WHEN s = 0 THEN 0.5 ELSE 0.25 END AS w FROM embeddings, range(2) t(s)), m AS (SELECT f AS frame, v, sum(w*cos(f*0.1*(j+1))) AS x, sum(w*sin(f*0.1*(j+1))) AS y FROM w, range(3) t(f) GROUP BY f, v) SELECT frame, v AS vertex_idx, round(x/sqrt(x*x+y*y), 6) + 0.0 AS nx, round(y/sqrt(x*x+y*y), 6) + 0.0 AS ny, 0.0::DOUBLE AS nz FROM m")
def _(spark, d):
    v, w, bind, poses = _rig(spark, d)
    n = v.select("vertex_idx", F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    return told(skinning.skinned_normals(n, w, bind, poses), "frame", "vertex_idx", "nx", "ny", "nz")


@query("J27_compared_frames", "SELECT f AS frame, count(*) AS n, count(*) FILTER (vec_id % 10 = 0) AS over, 0.01::DOUBLE AS max_error FROM embeddings, range(3) t(f) GROUP BY f")
def _(spark, d):
    a = skinning.skinned_positions(*_rig(spark, d))
    return told(skinning.compared(a, a.withColumn("x", F.col("x") + F.when(F.col("vertex_idx") % 10 == 0, 0.01).otherwise(0.0))), "frame", "n", "over", "max_error")


@query("O06_skinning_buffers", "WITH w AS (SELECT vec_id AS v, s, vec_id*(s+1)%4 AS j, CASE WHEN s = 0 THEN 0.5 ELSE 0.25 END AS w FROM embeddings, range(2) t(s)) SELECT f AS frame, v AS vertex_idx, count(*) AS influences, round(sum(w), 6) + 0.0 AS total, round(sum(w*cos(f*0.1*(j+1))), 6) + 0.0 AS m00 FROM w, range(3) t(f) GROUP BY f, v")
def _(spark, d):
    _, w, bind, poses = _rig(spark, d)
    return told(skinning.mesh_buffers(w, bind, poses), "frame", "vertex_idx", "influences", "total", "m00")


@query("J12_F31_sphere_body", f"WITH {_PART}, s AS (SELECT i, im, x + CASE WHEN im = 0 THEN 0 ELSE vx*(1-0.1/30)/30 END AS x, y + CASE WHEN im = 0 THEN 0 ELSE vy*(1-0.1/30)/30 END AS y, z + CASE WHEN im = 0 THEN 0 ELSE vz*(1-0.1/30)/30 END AS z, CASE WHEN im = 0 THEN vx ELSE vx*(1-0.1/30) END AS vx, CASE WHEN im = 0 THEN vy ELSE vy*(1-0.1/30) END AS vy, CASE WHEN im = 0 THEN vz ELSE vz*(1-0.1/30) END AS vz FROM p), c AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM s), h AS (SELECT *, im <> 0 AND n < 0.16 AS hit, x/n AS ux, y/n AS uy, z/n AS uz, (vx*x+vy*y+vz*z)/n AS inward FROM c) SELECT i AS particle_idx, " + ", ".join(f"round(CASE WHEN hit THEN u{k}*0.16 ELSE {k} END, 6) + 0.0 AS {k}, round(CASE WHEN hit AND inward < 0 THEN v{k} - u{k}*inward*1.5 ELSE v{k} END, 6) + 0.0 AS v{k}" for k in "xyz") + ", hit::BIGINT AS collisions FROM h")
def _(spark, d):
    return told(particles.step(surfaces.particles(spark, d), 1 / 30, bodies=[particles.Sphere(0, 0, 0, 0.15, 0.5)]), "particle_idx", "x", "y", "z", "vx", "vy", "vz", "collisions")


@query("J12_F32_box_body", f"WITH {_PART}, s AS (SELECT i, im, {', '.join(f'{k} + CASE WHEN im = 0 THEN 0 ELSE v{k}*(1-0.1/30)/30 END AS {k}, CASE WHEN im = 0 THEN v{k} ELSE v{k}*(1-0.1/30) END AS v{k}' for k in 'xyz')} FROM p), g AS (SELECT *, [x+0.31, 0.31-x, y+0.31, 0.31-y, z+0.31, 0.31-z] AS g, im <> 0 AND abs(x) <= 0.31 AND abs(y) <= 0.31 AND abs(z) <= 0.31 AS hit FROM s), f AS (SELECT *, list_position(g, list_min(g)) - 1 AS side FROM g) SELECT i AS particle_idx, " + ", ".join(f"round(CASE WHEN hit AND side = {2 * a} THEN -0.31 WHEN hit AND side = {2 * a + 1} THEN 0.31 ELSE {k} END, 6) + 0.0 AS {k}, round(CASE WHEN hit AND ((side = {2 * a} AND v{k} > 0) OR (side = {2 * a + 1} AND v{k} < 0)) THEN 0 ELSE v{k} END, 6) + 0.0 AS v{k}" for a, k in enumerate("xyz")) + ", hit::BIGINT AS collisions FROM f")
def _(spark, d):
    return told(particles.step(surfaces.particles(spark, d), 1 / 30, bodies=[particles.Box((-0.3, -0.3, -0.3), (0.3, 0.3, 0.3))]), "particle_idx", "x", "y", "z", "vx", "vy", "vz", "collisions")


@query("A16_A17_counters", "WITH s AS (SELECT event_id % 3 AS checks, event_id % 5 AS influences, event_id % 2 AS impulses, event_id % 7 AS clamped, event_id % 11 AS collisions, value AS vx FROM events WHERE value IS NOT NULL) SELECT count(*) AS particle_count, sum(checks)::BIGINT AS checks, sum(influences)::BIGINT AS influences, sum(impulses)::BIGINT AS impulses, sum(clamped)::BIGINT AS clamped, sum(collisions)::BIGINT AS collisions, round(max(abs(vx)), 6) + 0.0 AS max_speed FROM s")
def _(spark, d):
    i = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").filter("value is not null").select(*[(i % m).alias(n) for n, m in (("checks", 3), ("influences", 5), ("impulses", 2), ("clamped", 7), ("collisions", 11))], F.col("value").alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    return told(particles.counters(rows), "particle_count", "checks", "influences", "impulses", "clamped", "collisions", "max_speed")


@query("T01_T03_frame_steps", f"WITH {_PART}, a AS (SELECT i, im, x, y, z, vx, vy + CASE WHEN sqrt(x*x+y*y+z*z) <= 0.25 THEN (1 - sqrt(x*x+y*y+z*z)/0.25)*0.1*im ELSE 0 END AS vy, vz FROM p), d AS (SELECT 1 - 0.1::DOUBLE/60 AS k) SELECT i AS particle_idx, " + ", ".join(f"round(CASE WHEN im = 0 THEN {c} ELSE {c} + v{c}*(k + k*k + k*k*k)/60 END, 6) + 0.0 AS {c}" for c in "xyz") + ", round(CASE WHEN im = 0 THEN vx ELSE vx*k*k*k END, 6) + 0.0 AS vx FROM a, d")
def _(spark, d):
    out, _, _ = particles.frame(surfaces.particles(spark, d), 0.05, impulses=[particles.Impulse(0, 0, 0, 0.25, 0, 0.1, 0)])
    return told(out, "particle_idx", "x", "y", "z", "vx")
