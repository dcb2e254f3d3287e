"""Queries of single functions, and of short runs of all scenarios, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _PART, _REGION, _RING, _VOX, _body, _ring, _scenario_of, _stacked, _V, closest_sql, points_sql, query, told, wavy, wavy_sql
from .catalog_runtime import _quasi_sql
from .functions import vectors
from .functions.vectors import Vec
from .operators import circuit, coordinates, geometry, particles, runs, runtime, sampling, scenario, sdf, walk
from .sources import surfaces

# Pairs of vectors: a from one part of an embedding, b from another.
_AB = "ab AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS az, embedding[4]::DOUBLE AS bx, embedding[5]::DOUBLE AS \"by\", embedding[6]::DOUBLE AS bz, embedding[7]::DOUBLE AS cx, embedding[8]::DOUBLE AS cy, embedding[9]::DOUBLE AS cz, embedding[10]::DOUBLE AS px, embedding[11]::DOUBLE AS py, embedding[12]::DOUBLE AS pz FROM embeddings)"


def _ab(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("i"), *[F.element_at("embedding", 3 * v + k + 1).cast("double").alias(f"{n}{x}") for v, n in enumerate("abcp") for k, x in enumerate("xyz")])


@query("F01_vector_products", f"WITH {_AB} SELECT i, round(ax*bx+ay*\"by\"+az*bz,6)+0.0 AS dot, round(ay*bz-az*\"by\",6)+0.0 AS x, round(az*bx-ax*bz,6)+0.0 AS y, round(ax*\"by\"-ay*bx,6)+0.0 AS z, round(sqrt(ax*ax+ay*ay+az*az),6)+0.0 AS length, round(sqrt((ax-bx)*(ax-bx)+(ay-\"by\")*(ay-\"by\")+(az-bz)*(az-bz)),6)+0.0 AS distance FROM ab")
def _(spark, d):
    a, b = Vec.of("a"), Vec.of("b")
    return told(_ab(spark, d).select("i", a.dot(b).alias("dot"), *a.cross(b).aliased(), a.length().alias("length"), a.minus(b).length().alias("distance")), "i", "dot", "x", "y", "z", "length", "distance")


@query("F02_unit_vectors", f"WITH {_AB}, s AS (SELECT i, CASE WHEN i % 5 = 0 THEN 0 ELSE ax END AS x, CASE WHEN i % 5 = 0 THEN 0 ELSE ay END AS y, CASE WHEN i % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN i % 5 = 0 THEN 1e-7 ELSE az END AS z FROM ab), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM s), o AS (SELECT *, n > 1e-6 AND NOT isnan(n) AS ok FROM n) SELECT i, round(CASE WHEN ok THEN x/n ELSE 0 END,6)+0.0 AS x, round(CASE WHEN ok THEN y/n ELSE 1 END,6)+0.0 AS y, round(CASE WHEN ok THEN z/n ELSE 0 END,6)+0.0 AS z FROM o")
def _(spark, d):
    small, odd = F.col("i") % 5 == 0, F.col("i") % 7 == 0
    v = Vec(F.when(small, 0.0).otherwise(F.col("ax")), F.when(small, 0.0).otherwise(F.col("ay")), F.when(odd, float("nan")).when(small, 1e-7).otherwise(F.col("az")))
    return told(_ab(spark, d).select("i", *v.aliased("s")).select("i", *Vec.of("s").normalized_or(Vec.lit(0, 1, 0)).aliased()), "i", "x", "y", "z")


@query("F03_closest_on_triangle", f"WITH {_AB}, tr AS (SELECT i AS tri_idx, ax, ay, az, bx, \"by\", bz, cx, cy, cz, 0 AS nx, 0 AS ny, 0 AS nz, px AS qx, py AS qy, pz AS qz FROM ab), pts AS (SELECT i AS point_idx, px AS x, py AS y, pz AS z FROM ab), {closest_sql('pts', '(SELECT tri_idx, ax, ay, az, bx, \"by\", bz, cx, cy, cz, nx, ny, nz FROM tr)')} SELECT point_idx AS i, round(sqrt(dd),6)+0.0 AS distance FROM d5 WHERE point_idx = tri_idx")
def _(spark, d):
    out = vectors.with_closest_on_triangle(_ab(spark, d))
    return told(out.select("i", Vec.of("p").minus(Vec.of("q")).length().alias("distance")), "i", "distance")


@query("F04_triangle_areas", f"WITH {_AB}, c AS (SELECT i, (\"by\"-ay)*(cz-az)-(bz-az)*(cy-ay) AS x, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS y, (bx-ax)*(cy-ay)-(\"by\"-ay)*(cx-ax) AS z FROM ab) SELECT i, CASE WHEN sqrt(x*x+y*y+z*z)/2 > 1e-9 THEN round(sqrt(x*x+y*y+z*z)/2,6)+0.0 END AS area FROM c")
def _(spark, d):
    return told(_ab(spark, d).select("i", vectors.triangle_area(Vec.of("a"), Vec.of("b"), Vec.of("c")).alias("area")), "i", "area")


@query("F27_F28_F29_limited_vectors", f"WITH {_AB}, t AS (SELECT i, ax-bx*(ax*bx+ay*\"by\"+az*bz) AS x, ay-\"by\"*(ax*bx+ay*\"by\"+az*bz) AS y, az-bz*(ax*bx+ay*\"by\"+az*bz) AS z FROM ab), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM t) SELECT i, round(x*CASE WHEN n > 0.1 THEN 0.1/n ELSE 1 END,6)+0.0 AS x, round(y*CASE WHEN n > 0.1 THEN 0.1/n ELSE 1 END,6)+0.0 AS y, round(z*CASE WHEN n > 0.1 THEN 0.1/n ELSE 1 END,6)+0.0 AS z, 0.0::DOUBLE AS stopped FROM n")
def _(spark, d):
    flat = _ab(spark, d).select("i", *vectors.project_to_tangent(Vec.of("a"), Vec.of("b")).aliased("t"))
    return told(flat.select("i", *vectors.clamp_length(Vec.of("t"), 0.1).aliased(), (vectors.clamp_speed(Vec.of("t"), 0.0).x + 0.0).alias("stopped")), "i", "x", "y", "z", "stopped")


@query("F30_reflected", f"WITH {_AB}, d AS (SELECT *, ax*bx+ay*\"by\"+az*bz AS inward FROM ab) SELECT i, round(ax - CASE WHEN inward < 0 THEN inward*1.4 ELSE 0 END * bx,6)+0.0 AS x, round(ay - CASE WHEN inward < 0 THEN inward*1.4 ELSE 0 END * \"by\",6)+0.0 AS y FROM d")
def _(spark, d):
    v = particles.reflected(Vec.of("a"), Vec.of("b"), 0.4)
    return told(_ab(spark, d).select("i", v.x.alias("x"), v.y.alias("y")), "i", "x", "y")


@query("F23_F24_gate_factors", f"WITH {_AB} SELECT i, " + ", ".join(f"round(0.3+(1.65-0.3)/(1+exp(-least(greatest(({s}-0.07)/0.018,-50),50))),6)+0.0 AS {n}" for n, s in (("difference", "abs(bx-ax)"), ("source", "ax"), ("target", "bx"), ("memory", "cx"))) + " FROM ab")
def _(spark, d):
    of = lambda s: circuit.Gate(s).factor(F.col("ax"), F.col("bx"), F.col("cx"))
    return told(_ab(spark, d).select("i", *[of(s).alias(s) for s in ("difference", "source", "target", "memory")]), "i", "difference", "source", "target", "memory")


@query("F25_F26_term_currents", f"WITH {_AB} SELECT i, round(least(greatest(CASE i % 4 WHEN 0 THEN 9.0*(0-ax) WHEN 1 THEN 0.5 WHEN 2 THEN 60*(1.0-ax) ELSE 0.06/(1+exp(-(ax-0.16)/0.05))*(-0.25-ax) END,-8),8),6)+0.0 AS current FROM ab")
def _(spark, d):
    k = F.col("i") % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    rows = _ab(spark, d).select("i", "ax", pick("leak", "constant", "pump", "gated").alias("kind"), pick(9.0, 0.5, 60.0, 0.06).alias("p1"), pick(0.0, 0.0, 1.0, -0.25).alias("p2"), F.lit(0.16).alias("p3"), F.lit(0.05).alias("p4"))
    return told(rows.select("i", vectors.clamp(circuit.term_current(F.col("ax")), -8, 8).alias("current")), "i", "current")


@query("F06_barycentric_places", f"WITH {wavy_sql()}, b AS (SELECT event_id AS i, event_id % 512 AS tri_idx, (event_id % 10)/10.0::DOUBLE AS b1, (1-(event_id % 10)/10.0::DOUBLE)*(event_id % 7)/7.0::DOUBLE AS b2 FROM events) SELECT i AS sample_idx, " + ", ".join(f"round(a{k}*(1-b1-b2)+\"b{k}\"*b1+c{k}*b2,6)+0.0 AS {k}" for k in "xyz") + " FROM b JOIN faces USING (tri_idx)")
def _(spark, d):
    i = F.col("event_id")
    b1 = (i % 10) / 10
    b2 = (1 - b1) * (i % 7) / 7
    anchors = spark.read.parquet(f"{d}/events.parquet").select(i.alias("sample_idx"), (i % 512).alias("tri_idx"), (1 - b1 - b2).alias("b0"), b1.alias("b1"), b2.alias("b2"))
    return told(coordinates.updated(anchors, wavy(spark)), "sample_idx", "x", "y", "z")


@query("F17_F18_cell_centres", f"WITH {_VOX} SELECT point_idx AS linear, ix, iy, iz, round(ox+(ix+0.5)*0.1,6)+0.0 AS x, round(oy+(iy+0.5)*0.1,6)+0.0 AS y, round(oz+(iz+0.5)*0.1,6)+0.0 AS z, point_idx AS back FROM idx")
def _(spark, d):
    grid = sdf.build(wavy(spark, 8), 0.1, 1, signed=False)
    at = grid.voxels.select("linear", "ix", "iy", "iz", *[(F.lit(o) + (F.col(f"i{k}") + 0.5) * grid.voxel).alias(k) for k, o in zip("xyz", grid.origin, strict=True)])
    back = sdf.nearest(at.withColumnRenamed("linear", "own"), grid).select(F.col("own").alias("linear"), "ix", "iy", "iz", "x", "y", "z", F.col("linear").alias("back"))
    return told(back, "linear", "ix", "iy", "iz", "x", "y", "z", "back")


@query("A07_J01_grid_by_cells", f"WITH {_VOX} SELECT point_idx AS linear, round(plain,6)+0.0 AS distance FROM grid")
def _(spark, d):
    from .operators.distance import closest_surface

    surface = wavy(spark, 8)
    grid = sdf.build(surface, 0.1, 1, signed=False)
    centres = grid.voxels.select(F.col("linear").alias("point_idx"), *[(F.lit(o) + (F.col(f"i{k}") + 0.5) * grid.voxel).alias(k) for k, o in zip("xyz", grid.origin, strict=True)])
    return told(closest_surface(centres, surface, cell=0.125).withColumnRenamed("point_idx", "linear"), "linear", "distance")


@query("F42_F45_bands_of_the_axis", f"WITH {_REGION} SELECT node_idx, round(ap,6)+0.0 AS ap, round(nz,6)+0.0 AS nz, nz BETWEEN 0.05 AND 0.27 AS in_band FROM rg")
def _(spark, d):
    mapped, _ = _body(spark)
    band = scenario.in_band(mapped, 0.05, 0.27).select("node_idx", F.lit(True).alias("in_band"))
    return told(mapped.join(band, "node_idx", "left").withColumn("in_band", F.coalesce("in_band", F.lit(False))), "node_idx", "ap", "nz", "in_band")


@query("S21_N147_packed_circuit", f"WITH {_REGION}, v AS (SELECT node_idx, {_V} AS v FROM rg) SELECT node_idx AS idx, round(v,6)+0.0 AS voltage, 0.0::DOUBLE AS memory, round(least(greatest(0.5+1.5*v,0),1),6)+0.0 AS head, round(least(greatest(0.5-1.5*v,0),1),6)+0.0 AS tail FROM v")
def _(spark, d):
    state = scenario.initial_state(_body(spark)[0], "transient_no_memory_control")
    packed = coordinates.packed_nodes(state, "node_idx", "voltage", "memory", "readout", "tail")
    return told(packed.select("idx", *[F.get("packed", k).alias(n) for k, n in enumerate(("voltage", "memory", "head", "tail"))]), "idx", "voltage", "memory", "head", "tail")


@query("T17_collider_outcomes", "SELECT event_id AS frame_idx, CASE WHEN user_id % 2 = 0 THEN 'disabled' WHEN event_id = (SELECT min(event_id) FROM events) THEN 'initialized' WHEN event_id % 50 = 0 THEN 'changed_topology' ELSE 'updated' END AS collider FROM events")
def _(spark, d):
    i = F.col("event_id")
    frames = spark.read.parquet(f"{d}/events.parquet").select(F.lit(0).alias("sequence_id"), i.alias("frame_idx"), F.floor(i / 50).alias("topology"), (F.col("user_id") % 2 != 0).alias("collider"))
    return runtime.update_outcomes(frames).select("frame_idx", "collider")


@query("X01_sampled_force_step", f"WITH {_PART}, f AS (SELECT *, (vx + y/30)*(1-0.1/30) AS wx, (vy - x/30)*(1-0.1/30) AS wy, vz*(1-0.1/30) AS wz FROM p) SELECT i AS particle_idx, round(CASE WHEN im = 0 THEN x ELSE x + wx/30 END,6)+0.0 AS x, round(CASE WHEN im = 0 THEN y ELSE y + wy/30 END,6)+0.0 AS y, round(CASE WHEN im = 0 THEN z ELSE z + wz/30 END,6)+0.0 AS z FROM f")
def _(spark, d):
    p = surfaces.particles(spark, d)
    force = p.select("particle_idx", F.col("y").alias("ax"), (-F.col("x")).alias("ay"), F.lit(0.0).alias("az"))
    return told(particles.step(p, 1 / 30, force=force), "particle_idx", "x", "y", "z")


@query("X03_J08_candidates", f"WITH {points_sql()} SELECT a.point_idx AS particle_idx, count(*) AS candidates FROM pts a JOIN pts b ON a.point_idx <> b.point_idx AND abs(floor(a.x/0.15)-floor(b.x/0.15)) <= 1 AND abs(floor(a.y/0.15)-floor(b.y/0.15)) <= 1 AND abs(floor(a.z/0.15)-floor(b.z/0.15)) <= 1 GROUP BY a.point_idx")
def _(spark, d):
    return told(particles.neighbor_forces(surfaces.particles(spark, d), 0.15, 0.0).withColumnRenamed("checks", "candidates"), "particle_idx", "candidates")


@query("A03_A04_N026_centred_normals", f"WITH {wavy_sql()}, c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM vert) SELECT vertex_idx, round(x-mx,6)+0.0 AS x, round(y-my,6)+0.0 AS y, round(z-mz,6)+0.0 AS z FROM vert, c")
def _(spark, d):
    v = geometry.vertex_normals(wavy(spark)).crossJoin(F.broadcast(geometry.surface_center(wavy(spark)).select(*[F.col(k).alias(f"m{k}") for k in "xyz"])))  # one row
    return told(v.select("vertex_idx", *[(F.col(k) - F.col(f"m{k}")).alias(k) for k in "xyz"]), "vertex_idx", "x", "y", "z")


# Twelve steps of all scenarios, with the transient acting in them, on edges that SQL can name.

STEPS, STRIDE = 12, 4
_DT = "(1/30.0::DOUBLE)"
_LAST = f"""s AS (SELECT unnest({list(scenario.SCENARIOS)!r}) AS sc), e AS (SELECT sc, f, g, (CASE WHEN tier = 1 THEN 0.12::DOUBLE ELSE 0.03::DOUBLE END) * CASE WHEN sc = 'gap_block' AND (a.nz < 0.16) <> (b.nz < 0.16) THEN 0.08::DOUBLE ELSE 1 END AS base, (a.nz < 0.16) <> (b.nz < 0.16) AS across FROM ({_RING}) r JOIN rg a ON a.node_idx = f JOIN rg b ON b.node_idx = g, s),
nd AS (SELECT sc, node_idx AS n, nz, region, ({_V})::DOUBLE AS t FROM rg, s),
run AS (SELECT 0 AS k, sc, n, t AS v, 0::DOUBLE AS m, least(greatest(0.5+1.5*t,0),1) AS h, least(greatest(0.5-1.5*t,0),1) AS l FROM nd
 UNION ALL SELECT k + 1, sc, n, v, m, least(greatest(h + {_DT}*2*(0.5+1.5*v+0.7*m-h),0),1), least(greatest(l + {_DT}*2*(0.5-1.5*v-0.5*m-l),0),1) FROM (
  SELECT k, sc, n, v, h, l, CASE WHEN sc = 'transient_no_memory_control' THEN 0 ELSE least(greatest(CASE WHEN v >= 0.25 THEN m + {_DT}*4*(1-m) WHEN v <= -0.95 THEN m - {_DT}*0.04*m ELSE m END,0),1) END AS m FROM (
   SELECT r.k, r.sc, r.n, r.m, r.h, r.l, least(greatest(r.v + {_DT}*(coalesce(f.flow,0) + 0.05*(0-r.v) + 1.15*(nd.t-r.v) + CASE WHEN r.sc = 'transverse_cut_wound' AND nz BETWEEN 0.05 AND 0.27 THEN 1.65 ELSE 0 END + CASE WHEN starts_with(r.sc, 'transient') AND region <= 2 AND r.k >= 2 THEN 2.75 ELSE 0 END),-1),1) AS v
   FROM run r JOIN nd ON nd.sc = r.sc AND nd.n = r.n LEFT JOIN (SELECT e.sc, e.f, sum(least(greatest(least(greatest(base*(0.35+(1.45-0.35)/(1+exp(-least(greatest((abs(y.v-x.v)-0.12)/0.035,-50),50)))),0),4)*(y.v-x.v),-8),8)) AS flow FROM e JOIN run x ON x.sc = e.sc AND x.n = e.f JOIN run y ON y.sc = e.sc AND y.n = e.g GROUP BY e.sc, e.f) f ON f.sc = r.sc AND f.f = r.n
   WHERE r.k < {STEPS})))"""


@query("T23_A31_A32_W05_scenario_runs", f"WITH RECURSIVE {_REGION}, {_LAST}, x AS (SELECT sc, avg(base) AS cut_conductance FROM e WHERE across GROUP BY sc) SELECT sc AS scenario, k::BIGINT AS step, round(avg(m) FILTER (region <= 2),6)+0.0 AS posterior_memory, round(avg(h) FILTER (region <= 2),6)+0.0 AS posterior_head, round(avg(h) FILTER (region = 5),6)+0.0 AS head_at_head, round(avg(l) FILTER (region = 1),6)+0.0 AS tail_at_tail, round(avg(v) FILTER (nz BETWEEN 0.05 AND 0.27),6)+0.0 AS cut_voltage, round(any_value(cut_conductance),6)+0.0 AS cut_conductance FROM run JOIN nd USING (sc, n) JOIN x USING (sc) WHERE k % {STRIDE} = 0 GROUP BY sc, k")
def _(spark, d):
    mapped, _ = _body(spark)
    number = lambda df: df.withColumn("circuit_id", (F.array_position(F.array(*[F.lit(k) for k in scenario.SCENARIOS]), F.col("scenario")) - 1).cast("bigint"))
    nodes, edges, terms = (number(_stacked(f)) for f in (lambda k: scenario.initial_state(mapped, k), lambda k: scenario.scenario_edges(_ring(spark), mapped, k), lambda k: scenario.scenario_terms(mapped, k)))
    frames = runs.run(nodes, edges, terms, STEPS, STRIDE, circuit.Gate(*scenario.GATE), circuit.Memory(*scenario.MEMORY)).withColumn("scenario", _scenario_of(F.col("circuit_id")))
    return told(scenario.trace_set(frames, mapped, edges), "scenario", "step", "posterior_memory", "posterior_head", "head_at_head", "tail_at_tail", "cut_voltage", "cut_conductance")


# Neighbours by the way along a square of two triangles: its graph has 31 nodes, so the
# shortest ways are found by joining ways to ways five times.

SEED = 48161


def _walk_sql(n: int = 12) -> str:
    inverse = " + ".join(f"((i + 2) // {2**k} % 2) / {2 ** (k + 1)}.0::DOUBLE" for k in range(5))  # the seed is odd, so counting begins at 2
    corner = "CASE {0} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS x, CASE {0} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 END AS y"
    out = f"""vt AS (SELECT v, {corner.format('v')} FROM range(4) r(v)), tri AS (SELECT * FROM (VALUES (0, 0, 1, 2), (1, 0, 2, 3)) r(t, a, b, c)),
s0 AS (SELECT i, least(greatest({inverse}, 1e-6), 0.999999) AS f FROM range({n}) r(i)), s1 AS (SELECT i, CASE WHEN f <= 0.5 THEN 0 ELSE 1 END AS t FROM s0), s2 AS (SELECT i, t, row_number() OVER (PARTITION BY t ORDER BY i) - 1 AS l FROM s1),
s3 AS (SELECT i, t, sqrt({_quasi_sql('l', 't', SEED, 0)}) AS r, {_quasi_sql('l', 't', SEED, 1)} AS w FROM s2),
smp AS (SELECT i, s3.t, (1-r)*p.x+r*(1-w)*q.x+r*w*o.x AS x, (1-r)*p.y+r*(1-w)*q.y+r*w*o.y AS y FROM s3 JOIN tri ON tri.t = s3.t JOIN vt p ON p.v = a JOIN vt q ON q.v = b JOIN vt o ON o.v = c),
ends AS (SELECT t, least(u, w) AS lo, greatest(u, w) AS hi FROM (SELECT t, unnest([a, b, c]) AS u, unnest([b, c, a]) AS w FROM tri)),
nod AS (SELECT t, 'v' || v AS n, x, y FROM (SELECT t, unnest([a, b, c]) AS v FROM tri) JOIN vt USING (v) UNION ALL SELECT t, 'e' || lo || '_' || hi || '_' || k, p.x + (q.x-p.x)*k/4.0::DOUBLE, p.y + (q.y-p.y)*k/4.0::DOUBLE FROM ends JOIN vt p ON p.v = lo JOIN vt q ON q.v = hi, range(1, 4) r(k) UNION ALL SELECT t, 's' || i, x, y FROM smp),
w0 AS (SELECT a.n AS a, b.n AS b, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM nod a JOIN nod b ON a.t = b.t GROUP BY a.n, b.n)"""
    for k in range(5):
        out += f", w{k + 1} AS (SELECT p.a, q.b, min(p.d + q.d) AS d FROM w{k} p JOIN w{k} q ON p.b = q.a GROUP BY p.a, q.b)"
    return out + ", rk AS (SELECT substr(a, 2)::BIGINT AS f, substr(b, 2)::BIGINT AS g, d FROM w5 WHERE a <> b AND a LIKE 's%' AND b LIKE 's%')"


@query("J06_J07_O02_walk_tiers", f"WITH {_walk_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, g) AS rank FROM rk) SELECT f AS from_node, g AS to_node, rank, CASE WHEN rank <= 3 THEN 1 ELSE 2 END::BIGINT AS tier FROM o WHERE rank <= 6")
def _(spark, d):
    square = surfaces.unit_square(spark)
    return told(walk.tiers(square, sampling.samples(square, 12, SEED, sampling.LOW_DISCREPANCY), 3, 3), "from_node", "to_node", "rank", "tier")
