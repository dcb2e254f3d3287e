"""Queries over the driver's tables, one for each operator, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import Vec, rounded
from .operators import circuit, coordinates, distance, edits, fields, geometry, particles, runs, sampling, scenario, sdf, skinning
from .plans import rules
from .sources import surfaces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def told(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint", "smallint") else F.col(c) for c in columns])


# SQL for the procedural surfaces, as common table expressions.
N = 16


def wavy_sql(n: int = N, name: str = "") -> str:
    return f"""{name}vert AS (SELECT i AS vertex_idx, (i % {n + 1}) / CAST({n} AS DOUBLE) - CAST(0.5 AS DOUBLE) AS x, (i // {n + 1}) / CAST({n} AS DOUBLE) - CAST(0.5 AS DOUBLE) AS y,
 CAST(0.04 AS DOUBLE) * sin((i % {n + 1}) / CAST({n} AS DOUBLE) * 2 * pi()) * cos((i // {n + 1}) / CAST({n} AS DOUBLE) * 2 * pi()) AS z FROM range({(n + 1) ** 2}) t(i)),
{name}quad AS (SELECT q, (q // {n}) * {n + 1} + q % {n} AS a FROM range({n * n}) t(q)),
{name}tri AS (SELECT 2 * q AS tri_idx, a AS a, a + 1 AS b, a + {n + 1} AS c FROM {name}quad UNION ALL SELECT 2 * q + 1, a + 1, a + {n + 2}, a + {n + 1} FROM {name}quad),
{name}faces AS (SELECT t.tri_idx, t.a, t.b, t.c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS "by", q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
 FROM {name}tri t JOIN {name}vert p ON p.vertex_idx = t.a JOIN {name}vert q ON q.vertex_idx = t.b JOIN {name}vert r ON r.vertex_idx = t.c),
{name}nrm AS (SELECT *, ("by"-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-("by"-ay)*(cx-ax) AS nz FROM {name}faces),
{name}area AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) * 0.5 AS area FROM {name}nrm)"""


def points_sql(first: int = 1, name: str = "pts") -> str:
    return f"{name} AS (SELECT vec_id AS point_idx, CAST(embedding[{first}] AS DOUBLE) AS x, CAST(embedding[{first + 1}] AS DOUBLE) AS y, CAST(embedding[{first + 2}] AS DOUBLE) AS z FROM embeddings)"


def closest_sql(points: str, full: str = "area") -> str:
    """pairs(point_idx, tri_idx, d2, side) -> near(point_idx, d2, side): the least distance."""
    return f"""d0 AS (SELECT p.point_idx, p.x AS px, p.y AS py, p.z AS pz, t.*, t.bx-t.ax AS e1x, t."by"-t.ay AS e1y, t.bz-t.az AS e1z, t.cx-t.ax AS e2x, t.cy-t.ay AS e2y, t.cz-t.az AS e2z FROM {points} p, {full} t),
d1 AS (SELECT *, e1x*(px-ax)+e1y*(py-ay)+e1z*(pz-az) AS v1, e2x*(px-ax)+e2y*(py-ay)+e2z*(pz-az) AS v2, e1x*(px-bx)+e1y*(py-"by")+e1z*(pz-bz) AS v3, e2x*(px-bx)+e2y*(py-"by")+e2z*(pz-bz) AS v4,
 e1x*(px-cx)+e1y*(py-cy)+e1z*(pz-cz) AS v5, e2x*(px-cx)+e2y*(py-cy)+e2z*(pz-cz) AS v6 FROM d0),
d2 AS (SELECT *, v3*v6-v5*v4 AS va, v5*v2-v1*v6 AS vb, v1*v4-v3*v2 AS vc FROM d1),
d3 AS (SELECT *, CASE WHEN v1<=0 AND v2<=0 THEN 0 WHEN v3>=0 AND v4<=v3 THEN 1 WHEN vc<=0 AND v1>=0 AND v3<=0 THEN v1/nullif(v1-v3,0) WHEN v6>=0 AND v5<=v6 THEN 0 WHEN vb<=0 AND v2>=0 AND v6<=0 THEN 0
 WHEN va<=0 AND v4-v3>=0 AND v5-v6>=0 THEN 1-(v4-v3)/nullif((v4-v3)+(v5-v6),0) ELSE vb/nullif(va+vb+vc,0) END AS s,
 CASE WHEN v1<=0 AND v2<=0 THEN 0 WHEN v3>=0 AND v4<=v3 THEN 0 WHEN vc<=0 AND v1>=0 AND v3<=0 THEN 0 WHEN v6>=0 AND v5<=v6 THEN 1 WHEN vb<=0 AND v2>=0 AND v6<=0 THEN v2/nullif(v2-v6,0)
 WHEN va<=0 AND v4-v3>=0 AND v5-v6>=0 THEN (v4-v3)/nullif((v4-v3)+(v5-v6),0) ELSE vc/nullif(va+vb+vc,0) END AS t FROM d2),
d4 AS (SELECT point_idx, tri_idx, px-(ax+e1x*s+e2x*t) AS gx, py-(ay+e1y*s+e2y*t) AS gy, pz-(az+e1z*s+e2z*t) AS gz, nx, ny, nz FROM d3),
d5 AS (SELECT point_idx, tri_idx, gx*gx+gy*gy+gz*gz AS dd, gx*nx+gy*ny+gz*nz AS side FROM d4),
near AS (SELECT point_idx, min(dd) AS dd, count(*) AS tests, arg_min(side, (dd, tri_idx)) AS side FROM d5 GROUP BY point_idx)"""


def wavy(spark: SparkSession, n: int = N) -> surfaces.Surface:
    return surfaces.wavy_grid(spark, n)


# Surfaces, areas, bounds, normals.


@query("S11_J01_wavy_triangles", f"WITH {wavy_sql()} SELECT tri_idx, a, b, c, round((ax+bx+cx)/3,6)+0.0 AS gx, round((ay+\"by\"+cy)/3,6)+0.0 AS gy, round((az+bz+cz)/3,6)+0.0 AS gz FROM area")
def _(spark, d):
    return told(geometry.corners(wavy(spark)), "tri_idx", "a", "b", "c", "gx", "gy", "gz")


_W = "CASE WHEN z <= -0.62 THEN 0.045+(0.110-0.045)*((z+1)/(-0.62+1)) WHEN z <= -0.18 THEN 0.110+(0.150-0.110)*((z+0.62)/(-0.18+0.62)) WHEN z <= 0.24 THEN 0.150+(0.145-0.150)*((z+0.18)/(0.24+0.18)) WHEN z <= 0.66 THEN 0.145+(0.105-0.145)*((z-0.24)/(0.66-0.24)) ELSE 0.105+(0.060-0.105)*((z-0.66)/(1-0.66)) END"
AXIS_SQL = f"ax0 AS (SELECT i AS vertex_idx, -1.0 + 2.0 * (i // 9) / 28.0::DOUBLE AS z, -1.0 + 2.0 * (i % 9) / 8.0::DOUBLE AS l FROM range(261) t(i)), axv AS (SELECT vertex_idx, l * ({_W}) AS x, 0.018 * (1 - l*l) * (1 - 0.15*abs(z)) AS y, z FROM ax0)"


@query("S10_F40_axis_surface", f"WITH {AXIS_SQL} SELECT vertex_idx, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM axv")
def _(spark, d):
    return told(surfaces.axis_surface(spark).vertices, "vertex_idx", "x", "y", "z")


@query("S12_spiral_particles", "SELECT i AS particle_idx, round((0.18+(i%8)*0.008)*cos((i%64)*0.618034*2*pi()),6)+0.0 AS x, round((0.18+(i%8)*0.008)*sin((i%64)*0.618034*2*pi()),6)+0.0 AS y, round(sin((i//64)*0.017)*0.12,6)+0.0 AS z FROM range(2048) t(i)")
def _(spark, d):
    return told(surfaces.spiral_particles(spark, 2048), "particle_idx", "x", "y", "z")


def _unit_sql(seed: int) -> str:
    b = (seed + 1) * 2246822519 & 0xFFFFFFFF
    x = f"xor((((i+1)::HUGEINT*2654435761) % 4294967296)::BIGINT, {b})"
    for shift, k in ((16, 2246822507), (13, 3266489909)):
        x = f"((xor({x}, ({x}) >> {shift}))::HUGEINT * {k} % 4294967296)::BIGINT"
    x = f"xor({x}, ({x}) >> 16)"
    return f"(({x}) >> 8) / 16777215.0::DOUBLE"


@query("F11_F12_S13_random_sphere", f"WITH h AS (SELECT i, 2*({_unit_sql(7)})-1 AS z, 2*pi()*({_unit_sql(48)}) AS g, pow({_unit_sql(120)}, CAST(1 AS DOUBLE)/3)*0.5 AS r FROM range(500) t(i)) SELECT i AS particle_idx, round(sqrt(greatest(1-z*z,0))*cos(g)*r,6)+0.0 AS x, round(sqrt(greatest(1-z*z,0))*sin(g)*r,6)+0.0 AS y, round(z*r,6)+0.0 AS z, round(-0.025*z,6)+0.0 AS vz FROM h")
def _(spark, d):
    return told(surfaces.random_sphere(spark, 500, 0.5, 1.0, 7), "particle_idx", "x", "y", "z", "vz")


@query("A02_surface_area", f"WITH {wavy_sql()} SELECT round(sum(area),6)+0.0 AS area, count(*) AS triangles FROM area WHERE area > 1e-9")
def _(spark, d):
    return told(geometry.surface_area(wavy(spark)), "area", "triangles")


_NORMALS = f"""WITH {wavy_sql()}, part AS (SELECT a AS v, nx, ny, nz FROM nrm UNION ALL SELECT b, nx, ny, nz FROM nrm UNION ALL SELECT c, nx, ny, nz FROM nrm),
s AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM part GROUP BY v), u AS (SELECT vertex_idx, x, y, z, nx/sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny/sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz/sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM vert JOIN s ON v = vertex_idx)"""


@query("A03_vertex_normals", f"{_NORMALS} SELECT vertex_idx, round(nx,6)+0.0 AS nx, round(ny,6)+0.0 AS ny, round(nz,6)+0.0 AS nz FROM u")
def _(spark, d):
    return told(geometry.vertex_normals(wavy(spark)), "vertex_idx", "nx", "ny", "nz")


@query("F20_inflated_surface", f"{_NORMALS} SELECT vertex_idx, round(x+nx*0.02,6)+0.0 AS x, round(y+ny*0.02,6)+0.0 AS y, round(z+nz*0.02,6)+0.0 AS z FROM u")
def _(spark, d):
    return told(geometry.inflated(wavy(spark), 0.02).vertices, "vertex_idx", "x", "y", "z")


@query("W01_cumulative_area", f"WITH {wavy_sql()} SELECT tri_idx, round(sum(area) OVER (ORDER BY tri_idx),6)+0.0 AS high FROM area WHERE area > 1e-9")
def _(spark, d):
    return told(geometry.cumulative_areas(wavy(spark)), "tri_idx", "high")


@query("A01_point_bounds", f"WITH {points_sql()} SELECT " + ", ".join(f"round({f}({k}),6)+0.0 AS {f}_{k}" for f in ("min", "max") for k in "xyz") + " FROM pts")
def _(spark, d):
    return told(geometry.bounds(surfaces.points(spark, d)), *[f"{f}_{k}" for f in ("min", "max") for k in "xyz"])


@query("A04_surface_center", f"WITH {wavy_sql()} SELECT round(avg(x),6)+0.0 AS x, round(avg(y),6)+0.0 AS y, round(avg(z),6)+0.0 AS z FROM vert")
def _(spark, d):
    return told(geometry.surface_center(wavy(spark)), "x", "y", "z")


# Closest places, contacts, distance grids.


@query("J02_J03_closest_surface", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT point_idx, round(sqrt(dd),6)+0.0 AS distance, tests FROM near")
def _(spark, d):
    return told(distance.closest_surface(surfaces.points(spark, d), wavy(spark)), "point_idx", "distance", "tests")


@query("J02_bucketed_closest_surface", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT point_idx, round(sqrt(dd),6)+0.0 AS distance FROM near")
def _(spark, d):
    return told(distance.closest_surface(surfaces.points(spark, d), wavy(spark), cell=1 / N), "point_idx", "distance")


@query("J25_J36_contacts", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT point_idx, sqrt(dd) <= 0.05 AS touches, sqrt(dd) <= 0.07 AS overlaps FROM near")
def _(spark, d):
    probes = surfaces.points(spark, d).withColumn("radius", F.lit(0.05))
    return distance.contacts(probes, wavy(spark), 0.02).select("point_idx", "touches", "overlaps")


@query("A19_contact_counts", f"WITH {wavy_sql()}, {points_sql()}, {closest_sql('pts')} SELECT count(*) AS probes, count(*) AS contacts, count(*) FILTER (sqrt(dd) <= 0.05) AS touching, count(*) FILTER (sqrt(dd) <= 0.07) AS overlapping FROM near")
def _(spark, d):
    probes = surfaces.points(spark, d).withColumn("radius", F.lit(0.05))
    return distance.contact_counts(distance.contacts(probes, wavy(spark), 0.02))


_DIMS = "dim AS (SELECT ceil((max(x)-min(x)+0.2)/0.1-1e-9)::BIGINT AS nx, ceil((max(y)-min(y)+0.2)/0.1-1e-9)::BIGINT AS ny, greatest(2, ceil((max(z)-min(z)+0.2)/0.1-1e-9)::BIGINT) AS nz, min(x)-0.1 AS ox, min(y)-0.1 AS oy, min(z)-0.1 AS oz FROM vert)"
_VOX = f"""{wavy_sql(8)}, {_DIMS}, idx AS (SELECT i AS point_idx, i % nx AS ix, (i // nx) % ny AS iy, i // (nx*ny) AS iz, ox, oy, oz, nx, ny, nz FROM dim, LATERAL (SELECT unnest(range(nx*ny*nz)) AS i)),
vox AS (SELECT point_idx, ox+(ix+0.5)*0.1 AS x, oy+(iy+0.5)*0.1 AS y, oz+(iz+0.5)*0.1 AS z FROM idx), {closest_sql('vox')}, grid AS (SELECT i.*, CASE WHEN side < 0 THEN -sqrt(dd) ELSE sqrt(dd) END AS distance, sqrt(dd) AS plain FROM near JOIN idx i USING (point_idx))"""


@query("A06_F16_distance_grid", f"WITH {_VOX} SELECT point_idx AS linear, ix, iy, iz, round(plain,6)+0.0 AS distance FROM grid")
def _(spark, d):
    return told(sdf.build(wavy(spark, 8), 0.1, 1, signed=False).voxels, "linear", "ix", "iy", "iz", "distance")


@query("A08_A33_grid_summary", f"WITH {_VOX} SELECT count(*) AS sample_count, count(*)*128 AS triangle_tests, CAST(128 AS BIGINT) AS triangle_count, round(min(plain),6)+0.0 AS min_distance, round(max(plain),6)+0.0 AS max_distance FROM grid")
def _(spark, d):
    return told(sdf.diagnostics(sdf.build(wavy(spark, 8), 0.1, 1, signed=False), 128), "sample_count", "triangle_tests", "triangle_count", "min_distance", "max_distance")


_AT = "cellat AS (SELECT p.point_idx, CASE WHEN (x-ox)/0.1-0.5 >= 0 THEN floor((x-ox)/0.1-0.5+0.5)::BIGINT END AS jx, CASE WHEN (y-oy)/0.1-0.5 >= 0 THEN floor((y-oy)/0.1-0.5+0.5)::BIGINT END AS jy, CASE WHEN (z-oz)/0.1-0.5 >= 0 THEN floor((z-oz)/0.1-0.5+0.5)::BIGINT END AS jz FROM pts p, dim)"


@query("J15_grid_sample", f"WITH {_VOX}, {points_sql()}, {_AT} SELECT a.point_idx, round(plain,6)+0.0 AS sdf FROM cellat a LEFT JOIN grid g ON g.ix = jx AND g.iy = jy AND g.iz = jz")
def _(spark, d):
    return told(sdf.nearest(surfaces.points(spark, d), sdf.build(wavy(spark, 8), 0.1, 1, signed=False)), "point_idx", "sdf")


@query("J16_grid_sample_clamped", f"WITH {_VOX}, {points_sql()}, cellat AS (SELECT p.point_idx, least(greatest(floor((x-ox)/0.1-0.5+0.5)::BIGINT,0),nx-1) AS jx, least(greatest(floor((y-oy)/0.1-0.5+0.5)::BIGINT,0),ny-1) AS jy, least(greatest(floor((z-oz)/0.1-0.5+0.5)::BIGINT,0),nz-1) AS jz FROM pts p, dim) SELECT a.point_idx, round(plain,6)+0.0 AS sdf FROM cellat a LEFT JOIN grid g ON g.ix = jx AND g.iy = jy AND g.iz = jz")
def _(spark, d):
    return told(sdf.nearest(surfaces.points(spark, d), sdf.build(wavy(spark, 8), 0.1, 1, signed=False), clamped=True), "point_idx", "sdf")


@query("J17_grid_gradient", f"""WITH {_VOX}, diff AS (SELECT g.point_idx, {', '.join(f"(SELECT plain FROM grid h WHERE {' AND '.join(f'h.i{m} = ' + (f'least(g.i{m}+1, g.n{m}-1)' if m == k else f'g.i{m}') for m in 'xyz')}) - (SELECT plain FROM grid h WHERE {' AND '.join(f'h.i{m} = ' + (f'greatest(g.i{m}-1, 0)' if m == k else f'g.i{m}') for m in 'xyz')}) AS d{k}" for k in 'xyz')} FROM grid g)
SELECT point_idx AS linear, round(dx/sqrt(dx*dx+dy*dy+dz*dz),5)+0.0 AS gx, round(dy/sqrt(dx*dx+dy*dy+dz*dz),5)+0.0 AS gy, round(dz/sqrt(dx*dx+dy*dy+dz*dz),5)+0.0 AS gz FROM diff WHERE sqrt(dx*dx+dy*dy+dz*dz) > 1e-3""")
def _(spark, d):
    g = sdf.gradient(sdf.build(wavy(spark, 8), 0.1, 1, signed=False))
    return g.filter(Vec.of("g").length() > 0.5).select("linear", *[rounded(F.col(f"g{k}"), 5).alias(f"g{k}") for k in "xyz"])


# Samples and neighbours.


@query("J29_selected_triangles", f"WITH {wavy_sql()}, cum AS (SELECT tri_idx, sum(area) OVER (ORDER BY tri_idx) AS high FROM area WHERE area > 1e-9), s AS (SELECT i AS sample_idx, (i+0.37)/250.0::DOUBLE * (SELECT max(high) FROM cum) AS target FROM range(250) t(i)) SELECT sample_idx, min(tri_idx) AS tri_idx FROM s JOIN cum ON high >= target GROUP BY sample_idx")
def _(spark, d):
    f = spark.range(250).select(F.col("id").alias("sample_idx"), ((F.col("id") + 0.37) / 250).alias("f"))
    return sampling.selected_triangles(f, wavy(spark)).select("sample_idx", "tri_idx")


def _nodes(spark: SparkSession, d: str, first: int = 1) -> DataFrame:
    return surfaces.points(spark, d, first).withColumnRenamed("point_idx", "idx")


_TIERS = f"{points_sql()}, pr AS (SELECT a.point_idx AS from_node, b.point_idx AS to_node, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM pts a, pts b WHERE a.point_idx <> b.point_idx), rk AS (SELECT *, row_number() OVER (PARTITION BY from_node ORDER BY d2, to_node) AS rank FROM pr), edge AS (SELECT from_node, to_node, rank, CASE WHEN rank <= 6 THEN 1 ELSE 2 END AS tier FROM rk WHERE rank <= 18)"


@query("J05_W03_neighbor_tiers", f"WITH {_TIERS} SELECT from_node, to_node, rank, tier::BIGINT AS tier FROM edge")
def _(spark, d):
    return told(sampling.tiers(_nodes(spark, d)), "from_node", "to_node", "rank", "tier")


@query("A24_A35_tier_counts", f"WITH {_TIERS}, n AS (SELECT tier, from_node, count(*) AS n FROM edge GROUP BY ALL) SELECT tier::BIGINT AS tier, sum(n)::BIGINT AS edges, min(n) AS least, max(n) AS most FROM n GROUP BY tier")
def _(spark, d):
    return told(sampling.tier_counts(sampling.tiers(_nodes(spark, d))), "tier", "edges", "least", "most")


def _cross_sql(a: str, b: str, name: str, gate: str = "") -> str:
    return f"SELECT a.point_idx AS a_idx, b.point_idx AS b_idx, '{name}' AS direction, row_number() OVER (PARTITION BY a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS rank FROM {a} a, {b} b WHERE true {gate}"


for _name, _most in (("J04_O03_cross_neighborhood", 0.0), ("J04_gated_cross_neighborhood", 0.12)):
    _gate = f"AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= {_most}::DOUBLE*{_most}::DOUBLE" if _most else ""

    @query(_name, f"WITH {points_sql()}, {points_sql(4, 'other')}, r AS ({_cross_sql('pts', 'other', 'a_to_b', _gate)} UNION ALL {_cross_sql('other', 'pts', 'b_to_a', _gate)}) SELECT a_idx, b_idx, direction, rank FROM r WHERE rank <= 3")
    def _(spark, d, most=_most):
        return told(sampling.cross_neighborhood(_nodes(spark, d), _nodes(spark, d, 4), 3, most), "a_idx", "b_idx", "direction", "rank")


# Particles.

_R = 0.09


@query("J08_J09_neighbor_forces", f"WITH {points_sql()}, pr AS (SELECT a.point_idx AS i, a.x-b.x AS dx, a.y-b.y AS dy, a.z-b.z AS dz FROM pts a JOIN pts b ON a.point_idx <> b.point_idx AND abs(floor(a.x/{_R})-floor(b.x/{_R})) <= 1 AND abs(floor(a.y/{_R})-floor(b.y/{_R})) <= 1 AND abs(floor(a.z/{_R})-floor(b.z/{_R})) <= 1), f AS (SELECT *, dx*dx+dy*dy+dz*dz AS d2 FROM pr), g AS (SELECT *, CASE WHEN d2 > 1e-12 AND d2 <= {_R}::DOUBLE*{_R}::DOUBLE THEN (1-sqrt(d2)/{_R})*0.65/sqrt(d2) ELSE 0 END AS k FROM f) SELECT i AS particle_idx, round(sum(dx*k),6)+0.0 AS fx, round(sum(dy*k),6)+0.0 AS fy, round(sum(dz*k),6)+0.0 AS fz, count(*) AS checks FROM g GROUP BY i")
def _(spark, d):
    return told(particles.neighbor_forces(surfaces.particles(spark, d), _R, 0.65), "particle_idx", "fx", "fy", "fz", "checks")


_PART = "p AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[7]::DOUBLE AS vx, embedding[8]::DOUBLE AS vy, embedding[9]::DOUBLE AS vz, CASE WHEN label = 0 THEN 0.0 ELSE 1.0 END AS im FROM embeddings)"


@query("J10_J11_T02_particle_step", f"""WITH {_PART}, a AS (SELECT *, sqrt((0.1-x)*(0.1-x)+(0.2-y)*(0.2-y)+z*z) AS n, sqrt(x*x+y*y+z*z) AS m FROM p), b AS (SELECT *, CASE WHEN n > 1e-6 AND n <= 0.5 THEN 2.0*exp(-4*(n/0.5)*(n/0.5))/n ELSE 0 END AS k, CASE WHEN m <= 0.25 THEN 1-m/0.25 ELSE 0 END AS h FROM a),
v AS (SELECT *, (vx+(0.1-x)*k/30)*(1-0.1/30) AS wx, ((vy+(0.2-y)*k/30)+0.1*h*im)*(1-0.1/30) AS wy, (vz-z*k/30)*(1-0.1/30) AS wz FROM b), c AS (SELECT *, CASE WHEN sqrt(wx*wx+wy*wy+wz*wz) > 0.2 THEN 0.2/sqrt(wx*wx+wy*wy+wz*wz) ELSE 1 END AS q FROM v)
SELECT i AS particle_idx, round(CASE WHEN im = 0 THEN x ELSE x+wx*q/30 END,6)+0.0 AS x, round(CASE WHEN im = 0 THEN y ELSE y+wy*q/30 END,6)+0.0 AS y, round(CASE WHEN im = 0 THEN z ELSE z+wz*q/30 END,6)+0.0 AS z, round(CASE WHEN im = 0 THEN vx ELSE wx*q END,6)+0.0 AS vx, CASE WHEN im = 0 THEN 0 ELSE (k > 0)::BIGINT END AS influences, CASE WHEN im = 0 THEN 0 ELSE (h > 0)::BIGINT END AS impulses, CASE WHEN im = 0 THEN 0 ELSE (q < 1)::BIGINT END AS clamped FROM c""")
def _(spark, d):
    out = particles.step(surfaces.particles(spark, d), 1 / 30, influences=[particles.Influence(0.1, 0.2, 0, 0.5, 2.0, "gaussian")], impulses=[particles.Impulse(0, 0, 0, 0.25, 0, 0.1, 0)], max_speed=0.2)
    return told(out, "particle_idx", "x", "y", "z", "vx", "influences", "impulses", "clamped")


@query("A15_render_bounds", f"WITH {_PART} SELECT count(*) AS n, " + ", ".join(f"round({f}({k}{s}0.01),6)+0.0 AS {f}_{k}" for f, s in (("min", "-"), ("max", "+")) for k in "xyz") + " FROM p")
def _(spark, d):
    return told(particles.render_bounds(surfaces.particles(spark, d)), "n", *[f"{f}_{k}" for f in ("min", "max") for k in "xyz"])


@query("S18_S19_render_payload", f"WITH {_PART} SELECT i AS particle_idx, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z, round(sqrt(vx*vx+vy*vy+vz*vz),6)+0.0 AS speed FROM p")
def _(spark, d):
    return told(particles.render_payload(surfaces.particles(spark, d)), "particle_idx", "x", "y", "z", "speed")


# Fields.


def _links(spark: SparkSession, d: str) -> DataFrame:
    return fields.plan(sampling.tiers(_nodes(spark, d)))


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.lit("morphogen").alias("field_id"), F.col("vec_id").alias("node_idx"), F.abs(F.element_at("embedding", 10).cast("double")).alias("value"))


_MEAN = f"{_TIERS}, val AS (SELECT vec_id AS node_idx, abs(embedding[10]::DOUBLE) AS value FROM embeddings), mean AS (SELECT from_node AS node_idx, sum(CASE WHEN tier = 1 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END * value)/sum(CASE WHEN tier = 1 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END) AS mean FROM edge JOIN val ON node_idx = to_node GROUP BY from_node)"


@query("T10_J20_neighbor_means", f"WITH {_MEAN} SELECT node_idx, round(mean,6)+0.0 AS mean FROM mean")
def _(spark, d):
    return told(fields.neighbor_means(_scalars(spark, d), _links(spark, d)), "node_idx", "mean")


@query("T08_scalar_step", f"WITH {_MEAN} SELECT node_idx, round(least(greatest(value+(2.4*(coalesce(mean,value)-value)-0.25*value)/30,0),1),6)+0.0 AS value FROM val LEFT JOIN mean USING (node_idx)")
def _(spark, d):
    nodes = _scalars(spark, d).select("node_idx", F.lit(1.0).alias("coupling"))
    return told(fields.scalar_step(_scalars(spark, d), _links(spark, d), nodes, fields.Config()), "node_idx", "value")


def _field_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select(F.col("idx").alias("node_idx"), "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.points(spark, d, 11).select(F.col("point_idx").alias("node_idx"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    effect = F.element_at(F.array(*[F.lit(x) for x in ("wound", "depolarize", "coupling", "polarity_set", "polarity_invert")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.filter(F.col("value").isNotNull()).select(F.col("event_id").alias("ord"), (F.col("user_id") % 400).alias("node_idx"), (F.col("event_id") % 60).alias("start_step"), (F.col("event_id") % 7 + 1).alias("duration"), effect.alias("effect"), F.lit("morphogen").alias("field_id"), (F.col("value") % 1.0).alias("amount"), F.lit(1.0).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))


@query("J26_active_schedule", "SELECT event_id AS ord, user_id % 400 AS node_idx FROM events WHERE value IS NOT NULL AND event_id % 60 <= 20 AND 20 < event_id % 60 + event_id % 7 + 1")
def _(spark, d):
    return fields.active(_schedule(spark, d), 20).select("ord", "node_idx")


@query("A21_A23_value_ranges", "SELECT 'morphogen' AS field_id, count(*) AS n, round(min(abs(embedding[10]::DOUBLE)),6)+0.0 AS least, round(max(abs(embedding[10]::DOUBLE)),6)+0.0 AS most FROM embeddings")
def _(spark, d):
    return told(fields.value_ranges(_scalars(spark, d)), "field_id", "n", "least", "most")


@query("A22_max_vector_length", "SELECT round(max(sqrt(embedding[11]::DOUBLE*embedding[11]+embedding[12]::DOUBLE*embedding[12]+embedding[13]::DOUBLE*embedding[13])),5)+0.0 AS max_length FROM embeddings")
def _(spark, d):
    return fields.max_vector_length(_vectors(spark, d)).select(rounded(F.col("max_length"), 5).alias("max_length"))


# Circuits.


def _circuit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    state = _nodes(spark, d).select(F.col("idx").alias("node_idx"), (0.18 * F.col("x") + 0.1 * F.col("y")).alias("voltage"), F.lit(0.0).alias("memory"), F.lit(0.0).alias("readout"))
    edges = circuit.conductances(sampling.tiers(_nodes(spark, d), 3, 3).select("from_node", "to_node", "tier"))
    terms = spark.createDataFrame([("leak", 0.16, 0.0, None, None, None, 0, None), ("pump", 0.1, 0.0, None, None, None, 0, None), ("gated", 0.06, -0.25, 0.16, 0.05, None, 0, None), ("constant", 0.85, None, None, None, 5, 0, 24)], "kind string, p1 double, p2 double, p3 double, p4 double, node_idx long, start_step int, duration int")
    return state, edges, terms


_CIRCUIT = f"""{points_sql()}, pr AS (SELECT a.point_idx AS f, b.point_idx AS t, row_number() OVER (PARTITION BY a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS rank FROM pts a, pts b WHERE a.point_idx <> b.point_idx), st AS (SELECT point_idx AS node_idx, 0.18*x+0.1*y AS v FROM pts),
eg AS (SELECT f, t, (CASE WHEN rank <= 3 THEN 0.16 ELSE 0.045 END)*(0.3+(1.65-0.3)/(1+exp(-least(greatest((abs(b.v-a.v)-0.07)/0.018,-50),50)))) AS g, b.v-a.v AS dv FROM pr JOIN st a ON a.node_idx = f JOIN st b ON b.node_idx = t WHERE rank <= 6), fl AS (SELECT f AS node_idx, sum(g*dv) AS flow FROM eg GROUP BY f),
cur AS (SELECT node_idx, v, flow + 0.16*(0-v) + 0.1*(0-v) + 0.06/(1+exp(-(v-0.16)/0.05))*(-0.25-v) + CASE WHEN node_idx = 5 THEN 0.85 ELSE 0 END AS i FROM st JOIN fl USING (node_idx))"""


@query("T11_J22_F25_circuit_step", f"WITH {_CIRCUIT} SELECT node_idx, round(least(greatest(v+i/60,-1),1),6)+0.0 AS voltage, round(i,6)+0.0 AS current FROM cur")
def _(spark, d):
    out, _ = circuit.step(*_circuit(spark, d), 0, circuit.Gate())
    return told(out, "node_idx", "voltage", "current")


@query("T12_T13_memory_and_readout", f"WITH {_CIRCUIT}, n AS (SELECT node_idx, least(greatest(v+i/60,-1),1) AS v FROM cur), m AS (SELECT node_idx, v, CASE WHEN v >= 0.24 THEN 1.9/60 ELSE 0 END AS m FROM n) SELECT node_idx, round(m,6)+0.0 AS memory, round((0.08+0.8*v+0.45*m)*1.25/60,6)+0.0 AS readout FROM m")
def _(spark, d):
    out, _ = circuit.step(*_circuit(spark, d), 0, circuit.Gate())
    return told(out, "node_idx", "memory", "readout")


@query("A36_circuit_diagnostics", f"WITH {_CIRCUIT} SELECT count(*) AS updated_nodes, round(max(abs(least(greatest(v+i/60,-1),1)-v)),6)+0.0 AS max_voltage_delta, round(sum(abs(i)),4)+0.0 AS net_current_abs_sum, (SELECT count(*) FROM eg) AS visited_edges FROM cur")
def _(spark, d):
    out, edges = circuit.step(*_circuit(spark, d), 0, circuit.Gate())
    return circuit.diagnostics(out, edges).select("updated_nodes", rounded(F.col("max_voltage_delta")).alias("max_voltage_delta"), rounded(F.col("net_current_abs_sum"), 4).alias("net_current_abs_sum"), "visited_edges")


@query("J30_voltage_neighborhood", f"WITH {_TIERS}, u AS (SELECT to_node AS n, tier FROM edge WHERE from_node = 5 UNION ALL SELECT from_node, tier FROM edge WHERE to_node = 5) SELECT n AS node_idx, min(tier)::BIGINT AS tier, round(pow(0.5,min(tier)),6)+0.0 AS weight FROM u WHERE n <> 5 GROUP BY n UNION ALL SELECT 5, 0, 1.0")
def _(spark, d):
    return told(circuit.voltage_neighborhood(sampling.tiers(_nodes(spark, d)), 5), "node_idx", "tier", "weight")


@query("W06_W07_latest_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 12")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("event_idx"))
    return circuit.latest_events(e, 12, "user_id").select("user_id", F.col("event_idx").alias("event_id"))


# Edits of 50 circuits of 64 nodes on rings.
NODES = 64
_EDITS = f"""ed AS (SELECT user_id % 50 AS c, event_id AS e, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 29 END AS expected, event_id % 8 AS op, CASE WHEN event_id % 8 = 7 AND event_id % 5 = 0 THEN NULL ELSE event_id % 131 % 67 END AS target, CASE WHEN event_id % 37 = 0 THEN NULL ELSE value / 10.0::DOUBLE - CASE WHEN event_id % 8 = 4 THEN 0 ELSE 1 END END AS amount, value / 5.0::DOUBLE - 1 AS amount2, CASE WHEN event_id % 4 = 1 THEN 0.1::DOUBLE END AS slope, event_id % 2 + 1 AS max_tier, 0.5::DOUBLE AS falloff, 'term' || (event_id % 90) AS term, event_id % 20 AS duration FROM events),
nd AS (SELECT c, n, (n * 7 % 11 - 5) / 10.0::DOUBLE AS voltage FROM range(50) a(c), range({NODES}) b(n)),
eg AS (SELECT c, 2 * n + t - 1 AS edge, n AS f, (n + CASE WHEN t = 1 THEN 1 ELSE 5 END) % {NODES} AS g, t AS tier, CASE WHEN t = 1 THEN 0.16::DOUBLE ELSE 0.045::DOUBLE END AS base FROM range(50) a(c), range({NODES}) b(n), range(1, 3) d(t)),
inv AS (SELECT *, CASE WHEN NOT (op = 7 AND target IS NULL) AND NOT coalesce(target BETWEEN 0 AND CASE WHEN op IN (5, 6) THEN {2 * NODES - 1} ELSE {NODES - 1} END, false) THEN 'invalid_target' WHEN amount IS NULL OR isnan(amount) THEN 'invalid_value' WHEN op = 4 AND amount < 0 THEN 'invalid_value' WHEN op = 6 AND NOT coalesce(amount >= 0 AND amount <= amount2, false) THEN 'invalid_value' WHEN op = 7 AND duration <= 0 THEN 'invalid_value' END AS invalid, (op IN (5, 6) AND target % 2 = 1) OR (op = 3 AND c % 7 = 0) AS unavailable, row_number() OVER (PARTITION BY c ORDER BY e) AS r FROM ed),
run AS (SELECT c, r, e, ok, reason, before, before + ok::BIGINT AS after, CASE WHEN ok AND op = 7 THEN [term] ELSE []::VARCHAR[] END AS terms FROM (SELECT *, reason IS NULL AS ok FROM (SELECT *, c % 3 AS before, coalesce(invalid, CASE WHEN expected <> c % 3 THEN 'revision_mismatch' WHEN unavailable THEN 'target_unavailable' END) AS reason FROM inv WHERE r = 1))
 UNION ALL SELECT c, r, e, ok, reason, before, before + ok::BIGINT, CASE WHEN ok AND op = 7 THEN list_append(terms, term) ELSE terms END FROM (SELECT *, reason IS NULL AS ok FROM (SELECT i.*, p.after AS before, p.terms, coalesce(invalid, CASE WHEN expected <> p.after THEN 'revision_mismatch' WHEN unavailable OR (op = 7 AND list_contains(p.terms, term)) THEN 'target_unavailable' END) AS reason FROM run p JOIN inv i ON i.c = p.c AND i.r = p.r + 1))),
acc AS (SELECT ed.* FROM ed JOIN run USING (c, e) WHERE ok)"""
_OPS = f"""{_EDITS}, near AS (SELECT c, f AS n, g AS m, tier FROM eg UNION ALL SELECT c, g, f, tier FROM eg),
op AS (SELECT c, e, target AS n, CASE WHEN op = 0 THEN amount END AS put, amount AS add FROM acc WHERE op IN (0, 1, 2) UNION ALL SELECT a.c, e, m, NULL, amount * pow(falloff, min(tier)) FROM acc a JOIN near USING (c) WHERE op = 2 AND near.n = target AND tier <= max_tier AND m <> target GROUP BY a.c, e, m, amount, falloff),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c, n ORDER BY e) AS r FROM op),
fold AS (SELECT k.c, k.n, k.r, k.e, coalesce(put, voltage + add) AS raw, least(greatest(coalesce(put, voltage + add), -1), 1) AS v FROM ranked k JOIN nd ON nd.c = k.c AND nd.n = k.n WHERE r = 1 UNION ALL SELECT k.c, k.n, k.r, k.e, coalesce(put, v + add), least(greatest(coalesce(put, v + add), -1), 1) FROM fold f JOIN ranked k ON k.c = f.c AND k.n = f.n AND k.r = f.r + 1)"""
_SCALED = f"""{_EDITS}, ends AS (SELECT c, edge, base, f AS n FROM eg UNION SELECT c, edge, base, g FROM eg), ranked AS (SELECT s.c, e, edge, base, amount, row_number() OVER (PARTITION BY s.c, edge ORDER BY e) AS r FROM ends s JOIN acc a ON a.c = s.c AND a.op = 4 AND a.target = s.n),
fold AS (SELECT c, edge, r, least(greatest(base * amount, 0), 4) AS v FROM ranked WHERE r = 1 UNION ALL SELECT k.c, k.edge, k.r, least(greatest(v * amount, 0), 4) FROM fold f JOIN ranked k ON k.c = f.c AND k.edge = f.edge AND k.r = f.r + 1)"""


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edits, circuits, nodes and edges."""
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    op = F.element_at(F.array(*[F.lit(x) for x in edits.OPERATIONS]), (i % 8 + 1).cast("int"))
    target = F.when((i % 8 == 7) & (i % 5 == 0), None).otherwise(i % 131 % 67)
    amount = F.when(i % 37 == 0, None).otherwise(F.col("value") / 10 - F.when(i % 8 == 4, 0).otherwise(1))
    asked = e.select(
        (F.col("user_id") % 50).alias("circuit_id"), i.alias("event_idx"), F.when(i % 3 == 0, None).otherwise(i % 29).alias("expected_revision"), op.alias("operation"), target.alias("target"), amount.alias("amount"),
        (F.col("value") / 5 - 1).alias("amount2"), F.when(i % 4 == 1, 0.1).alias("slope"), (i % 2 + 1).alias("max_tier"), F.lit(0.5).alias("falloff"), F.concat(F.lit("term"), (i % 90).cast("string")).alias("term_id"), F.lit(0).alias("start_step"), (i % 20).alias("duration"),
    )
    circuits = spark.range(50).select(F.col("id").alias("circuit_id"), (F.col("id") % 3).alias("revision"), F.lit(NODES).alias("nodes"), F.lit(2 * NODES).alias("edges"), (F.col("id") % 7 != 0).alias("has_memory"))
    n, c = F.col("id") % NODES, F.floor(F.col("id") / NODES)
    nodes = spark.range(50 * NODES).select(c.alias("circuit_id"), n.alias("node_idx"), ((n * 7 % 11 - 5) / 10).alias("voltage"), F.lit(0.0).alias("memory"))
    k, m = F.col("id") % 2 + 1, F.floor(F.col("id") / 2) % NODES
    edges = spark.range(100 * NODES).select(F.floor(F.col("id") / (2 * NODES)).alias("circuit_id"), (2 * m + k - 1).alias("edge_idx"), m.alias("from_node"), ((m + F.when(k == 1, 1).otherwise(5)) % NODES).alias("to_node"), k.alias("tier"), F.when(k == 1, 0.16).otherwise(0.045).alias("base"))
    edges = edges.select("*", F.col("base").alias("conductance"), F.when(F.col("tier") == 1, 0.07).alias("threshold"), F.lit(0.018).alias("slope"), F.lit(0.3).alias("low"), F.lit(1.65).alias("high"))
    return asked, circuits, nodes, edges


def _accepted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, circuits, nodes, edges = _edited(spark, d)
    return edits.accepted(asked, edits.judged(asked, circuits, edges)), nodes, edges


@query("T14_judged_edits", f"WITH RECURSIVE {_EDITS} SELECT c AS circuit_id, e AS event_idx, ok AS accepted, reason, before AS revision_before, after AS revision_after FROM run")
def _(spark, d):
    asked, circuits, _, edges = _edited(spark, d)
    return edits.judged(asked, circuits, edges)


@query("T15_N105_N107_applied_voltages", f"WITH RECURSIVE {_OPS} SELECT c AS circuit_id, n AS node_idx, round(arg_max(v, r), 6) + 0.0 AS voltage FROM fold GROUP BY c, n")
def _(spark, d):
    out = edits.latest(edits.applied_voltages(*_accepted(spark, d)))
    return out.select("circuit_id", F.col("idx").alias("node_idx"), rounded(F.col("value")).alias("voltage"))


@query("T15_N112_clamped_values", f"WITH RECURSIVE {_OPS} SELECT c AS circuit_id, e AS event_idx, count(*) AS affected, count(*) FILTER (raw <> v) AS clamped_values FROM fold GROUP BY c, e")
def _(spark, d):
    return edits.effects(edits.applied_voltages(*_accepted(spark, d)))


@query("T15_N108_set_memories", f"WITH RECURSIVE {_EDITS} SELECT c AS circuit_id, target AS node_idx, round(least(greatest(arg_max(amount, e), 0), 1), 6) + 0.0 AS memory FROM acc WHERE op = 3 GROUP BY c, target")
def _(spark, d):
    out = edits.latest(edits.set_memories(_accepted(spark, d)[0]))
    return out.select("circuit_id", F.col("idx").alias("node_idx"), rounded(F.col("value")).alias("memory"))


@query("J31_N155_scaled_conductances", f"WITH RECURSIVE {_SCALED} SELECT c AS circuit_id, edge AS edge_idx, round(arg_max(v, r), 6) + 0.0 AS conductance FROM fold GROUP BY c, edge")
def _(spark, d):
    asked, _, edges = _accepted(spark, d)
    out = edits.latest(edits.scaled_conductances(asked, edges)).filter("what = 'conductance'")
    return out.select("circuit_id", F.col("idx").alias("edge_idx"), rounded(F.col("value")).alias("conductance"))


@query("T15_N109_N110_applied_gates", f"WITH RECURSIVE {_EDITS}, t AS (SELECT c, target AS edge, arg_max(amount, e) FILTER (op = 5) AS t, arg_max(slope, e) FILTER (op = 5 AND slope IS NOT NULL) AS s, arg_max(amount, e) FILTER (op = 6) AS lo, arg_max(amount2, e) FILTER (op = 6) AS hi FROM acc WHERE op IN (5, 6) GROUP BY c, target) SELECT c AS circuit_id, edge AS edge_idx, round(coalesce(t, 0.07), 6) + 0.0 AS threshold, round(coalesce(s, 0.018), 6) + 0.0 AS slope, round(coalesce(lo, 0.3), 6) + 0.0 AS low, round(coalesce(hi, 1.65), 6) + 0.0 AS high FROM eg LEFT JOIN t USING (c, edge) WHERE tier = 1")
def _(spark, d):
    asked, _, edges = _accepted(spark, d)
    return told(edits.applied_gates(asked, edges), "circuit_id", "edge_idx", "threshold", "slope", "low", "high")


@query("T15_N111_added_terms", f"WITH RECURSIVE {_EDITS} SELECT c AS circuit_id, term AS term_id, round(amount, 6) + 0.0 AS current, target AS node_idx, duration FROM acc WHERE op = 7")
def _(spark, d):
    return told(edits.added_terms(_accepted(spark, d)[0]), "circuit_id", "term_id", "current", "node_idx", "duration")


# Scenarios.


def _body(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = surfaces.axis_surface(spark).vertices.withColumnRenamed("vertex_idx", "node_idx")
    return scenario.axis_map(nodes), sampling.tiers(nodes.withColumnRenamed("node_idx", "idx"), 4, 4).select("from_node", "to_node", "tier")


_REGION = f"{AXIS_SQL}, fr AS (SELECT min(z) AS lo, max(z) AS hi, max(abs(x)) AS hw FROM axv), mp AS (SELECT vertex_idx AS node_idx, (z-lo)/(hi-lo) AS ap, 2*((z-lo)/(hi-lo))-1 AS nz, least(greatest(x/hw,-1.5),1.5) AS side FROM axv, fr), rg AS (SELECT *, CASE WHEN nz < -0.62 THEN 1 WHEN nz < -0.18 THEN 2 WHEN nz < 0.24 THEN 3 WHEN nz < 0.66 THEN 4 ELSE 5 END AS region FROM mp)"


@query("A25_F41_F43_axis_map", f"WITH {_REGION} SELECT node_idx, round(ap,6)+0.0 AS ap, round(side,6)+0.0 AS lateral_axis, region::BIGINT AS region FROM rg")
def _(spark, d):
    return told(_body(spark)[0].withColumnRenamed("lateral", "lateral_axis"), "node_idx", "ap", "lateral_axis", "region")


@query("A26_region_extents", f"WITH {_REGION} SELECT region::BIGINT AS region, count(*) AS n, round(count(*)/261.0::DOUBLE,6)+0.0 AS fraction, round(min(ap),6)+0.0 AS ap_min, round(max(ap),6)+0.0 AS ap_max, round(avg(abs(side)),6)+0.0 AS mean_lateral FROM rg GROUP BY region")
def _(spark, d):
    return told(scenario.region_extents(_body(spark)[0]), "region", "n", "fraction", "ap_min", "ap_max", "mean_lateral")


# Edges between nodes that are so many numbers apart.
_RING = "SELECT i AS f, (i + CASE WHEN t = 1 THEN 9 ELSE 13 END) % 261 AS g, t AS tier FROM range(261) a(i), range(1, 3) b(t)"


def _ring(spark: SparkSession) -> DataFrame:
    i, t = F.floor(F.col("id") / 2), F.col("id") % 2 + 1
    return spark.range(522).select(i.alias("from_node"), ((i + F.when(t == 1, 9).otherwise(13)) % 261).alias("to_node"), t.alias("tier"))


@query("A28_J32_cut_conductance", f"WITH {_REGION}, e AS ({_RING}) SELECT round(avg((CASE WHEN tier = 1 THEN 0.12 ELSE 0.03 END)*0.08),6)+0.0 AS average, count(*) AS edges FROM e JOIN rg a ON a.node_idx = f JOIN rg b ON b.node_idx = g WHERE (a.nz < 0.16) <> (b.nz < 0.16)")
def _(spark, d):
    mapped, _ = _body(spark)
    return told(scenario.cut_conductance(scenario.scenario_edges(_ring(spark), mapped, "gap_block"), mapped, scenario.CUT), "average", "edges")


_V = "CASE region WHEN 1 THEN -0.28 WHEN 2 THEN -0.14 WHEN 3 THEN 0.0 WHEN 4 THEN 0.14 ELSE 0.28 END"


@query("T22_F44_F46_initial_circuits", f"WITH {_REGION}, s AS (SELECT unnest({list(scenario.SCENARIOS)!r}) AS scenario), v AS (SELECT *, {_V} AS v FROM rg, s) SELECT scenario, node_idx, round(v,6)+0.0 AS voltage, CASE WHEN scenario <> 'transient_no_memory_control' THEN 0.0 END::DOUBLE AS memory, round(least(greatest(0.5+1.5*v,0),1),6)+0.0 AS readout, round(least(greatest(0.5-1.5*v,0),1),6)+0.0 AS tail FROM v")
def _(spark, d):
    mapped, _ = _body(spark)
    return told(_stacked(lambda k: scenario.initial_state(mapped, k)), "scenario", "node_idx", "voltage", "memory", "readout", "tail")


@query("T22_N118_scenario_terms", f"WITH {_REGION}, s AS (SELECT unnest({list(scenario.SCENARIOS)!r}) AS scenario) SELECT scenario, 'leak' AS kind, 1::BIGINT AS n, 0.05::DOUBLE AS p1, 0::BIGINT AS start_step FROM s UNION ALL SELECT scenario, 'pump', 261, 1.15, 0 FROM s UNION ALL SELECT 'transverse_cut_wound', 'constant', count(*), 1.65, 0 FROM rg WHERE nz BETWEEN 0.05 AND 0.27 UNION ALL SELECT scenario, 'constant', count(*), 2.75, 2 FROM rg, s WHERE region <= 2 AND starts_with(scenario, 'transient') GROUP BY scenario")
def _(spark, d):
    mapped, _ = _body(spark)
    return told(_stacked(lambda k: scenario.scenario_terms(mapped, k)).groupBy("scenario", "kind").agg(F.count("*").alias("n"), F.max("p1").alias("p1"), F.max("start_step").alias("start_step")), "scenario", "kind", "n", "p1", "start_step")


def _stacked(make) -> DataFrame:
    out = None
    for k in scenario.SCENARIOS:
        one = make(k).withColumn("scenario", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _runs(spark: SparkSession, steps: int = 150, stride: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames of all scenarios, the axis map, and the edges."""
    mapped, tiers = _body(spark)
    number = lambda df: df.withColumn("circuit_id", sum((F.when(F.col("scenario") == k, n).otherwise(0) for n, k in enumerate(scenario.SCENARIOS)), F.lit(0)).cast("bigint"))
    nodes, edges, terms = (number(_stacked(f)) for f in (lambda k: scenario.initial_state(mapped, k), lambda k: scenario.scenario_edges(tiers, mapped, k), lambda k: scenario.scenario_terms(mapped, k)))
    frames = runs.run(nodes, edges, terms, steps, stride, circuit.Gate(*scenario.GATE), circuit.Memory(*scenario.MEMORY))
    return frames.withColumn("scenario", _scenario_of(F.col("circuit_id"))), mapped, edges


def _scenario_of(code):
    return F.element_at(F.array(*[F.lit(k) for k in scenario.SCENARIOS]), (code + 1).cast("int"))


@query("T23_A31_A32_trace_set")
def _(spark, d):
    frames, mapped, edges = _runs(spark)
    return told(scenario.trace_set(frames, mapped, edges), "scenario", "step", "posterior_memory", "posterior_head", "head_at_head", "tail_at_tail", "cut_voltage", "cut_conductance")


@query("W04_W05_fixed_runs", "WITH n AS (SELECT user_id AS circuit_id, event_id AS node_idx, value / 1000.0::DOUBLE AS v FROM events WHERE event_id < 1000 AND value IS NOT NULL), s AS (SELECT i AS step FROM range(0, 61) t(i) WHERE i % 25 = 0 OR i = 60) SELECT circuit_id, step, node_idx, round(greatest(least(v * pow(1 - 0.16::DOUBLE / 30, step), 1), -1), 6) + 0.0 AS voltage FROM n, s")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id < 1000 and value is not null")
    nodes = e.select(F.col("user_id").alias("circuit_id"), F.col("event_id").alias("node_idx"), (F.col("value") / 1000).alias("voltage"), F.lit(None).cast("double").alias("memory"))
    edges = e.limit(0).select(F.col("user_id").alias("circuit_id"), F.lit(0).alias("from_node"), F.lit(0).alias("to_node"), F.lit(0.0).alias("base"))
    leak = nodes.select("circuit_id").distinct().select("circuit_id", F.lit("leak").alias("kind"), F.lit(0.16).alias("p1"), F.lit(0.0).alias("p2"), F.lit(None).cast("double").alias("p3"), F.lit(None).cast("double").alias("p4"), F.lit(None).cast("bigint").alias("node_idx"), F.lit(0).alias("start_step"), F.lit(None).cast("int").alias("duration"))
    return told(runs.run(nodes, edges, leak, 60, 25), "circuit_id", "step", "node_idx", "voltage")


# Frames that nothing has run, to measure.
_FRAMES = f"{_REGION}, fm AS (SELECT s AS step, rg.*, (node_idx * (s + 3) % 17) / 10.0::DOUBLE - 0.8 AS voltage, (node_idx * (s + 1) % 11) / 10.0::DOUBLE AS memory, (node_idx * (s + 5) % 13) / 12.0::DOUBLE AS head, (node_idx * (s + 2) % 7) / 6.0::DOUBLE AS tail FROM rg, range(6) t(s))"


def _made_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    mapped, _ = _body(spark)
    i, s = F.col("node_idx"), F.col("step")
    of = lambda k, m, d, o=0.0: (i * (s + k) % m) / d - o
    frames = mapped.select("node_idx", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step"))
    return frames.select("step", "node_idx", of(3, 17, 10, 0.8).alias("voltage"), of(1, 11, 10).alias("memory"), of(5, 13, 12).alias("head"), of(2, 7, 6).alias("tail")), mapped


@query("A27_A29_outcome_samples", f"WITH {_FRAMES} SELECT step::BIGINT AS step, round(avg(memory) FILTER (region <= 2),6)+0.0 AS posterior_memory, round(avg(head) FILTER (region <= 2),6)+0.0 AS posterior_head, round(avg(head) FILTER (region = 5),6)+0.0 AS head_at_head, round(avg(tail) FILTER (region = 1),6)+0.0 AS tail_at_tail, round(avg(voltage) FILTER (nz BETWEEN 0.05 AND 0.27),6)+0.0 AS cut_voltage FROM fm GROUP BY step")
def _(spark, d):
    return told(scenario.outcome_samples(*_made_frames(spark)), "step", "posterior_memory", "posterior_head", "head_at_head", "tail_at_tail", "cut_voltage")


@query("A30_head_extent", f"WITH {_FRAMES} SELECT round(avg((head >= 0.5)::INT),6)+0.0 AS head_extent FROM fm WHERE step = 5")
def _(spark, d):
    return told(scenario.head_extent(_made_frames(spark)[0].withColumnRenamed("head", "readout")), "head_extent")


@query("A37_node_activity", f"WITH {_FRAMES}, c AS (SELECT node_idx, abs(voltage - lag(voltage) OVER (PARTITION BY node_idx ORDER BY step)) AS c FROM fm), m AS (SELECT node_idx, max(c) AS c FROM c GROUP BY node_idx) SELECT node_idx, round(c / (SELECT max(c) FROM m),6)+0.0 AS activity FROM m")
def _(spark, d):
    return told(scenario.node_activity(_made_frames(spark)[0]), "node_idx", "activity")


@query("W04_W05_emitted_steps", "SELECT i AS step FROM range(0, 181) t(i) WHERE i % 25 = 0 OR i = 180")
def _(spark, d):
    return scenario.emitted(spark.range(181).select(F.col("id").alias("step")), 25)


# Skinning.


def _rig(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    v = surfaces.points(spark, d).withColumnRenamed("point_idx", "vertex_idx")
    w = v.select("vertex_idx", F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), (F.col("vertex_idx") * (s + 1) % 4).alias("joint"), F.lit(0.5 if s == 0 else 0.25).alias("weight")) for s in range(2)])))
    bind = spark.range(4).select(F.col("id").alias("joint"), (F.col("id") * 0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), *[F.lit(0.0).alias(f"q{k}") for k in "xyz"], F.lit(1.0).alias("qw"))
    angle = F.col("frame") * 0.1 * (F.col("joint") + 1)
    poses = bind.select("joint", "x").crossJoin(spark.range(3).withColumnRenamed("id", "frame")).select("frame", "joint", "x", (F.col("frame") * 0.05).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(angle / 2).alias("qz"), F.cos(angle / 2).alias("qw"))
    return v, w, bind, poses


@query("J23_F35_F36_skinned_positions", f"WITH {points_sql()}, w AS (SELECT point_idx AS v, x, y, z, point_idx*(s+1)%4 AS j, CASE WHEN s = 0 THEN 0.5 ELSE 0.25 END AS w FROM pts, range(2) t(s)), m AS (SELECT f AS frame, v, w, j*0.1 + (x-j*0.1)*cos(f*0.1*(j+1)) - y*sin(f*0.1*(j+1)) AS mx, f*0.05 + (x-j*0.1)*sin(f*0.1*(j+1)) + y*cos(f*0.1*(j+1)) AS my, z AS mz FROM w, range(3) t(f)) SELECT frame, v AS vertex_idx, round(sum(w*mx)/sum(w),6)+0.0 AS x, round(sum(w*my)/sum(w),6)+0.0 AS y, round(sum(w*mz)/sum(w),6)+0.0 AS z FROM m GROUP BY frame, v")
def _(spark, d):
    return told(skinning.skinned_positions(*_rig(spark, d)), "frame", "vertex_idx", "x", "y", "z")


@query("J33_evaluated_track", "WITH k AS (SELECT i % 7 AS joint, (i // 7)::DOUBLE AS t, (i * 37 % 11)::DOUBLE AS value FROM range(35) s(i)), q AS (SELECT i * 0.37::DOUBLE - 0.5::DOUBLE AS t FROM range(16) s(i)), a AS (SELECT j AS joint, q.t, (SELECT max(k.t) FROM k WHERE k.joint = j AND k.t <= q.t) AS lo, (SELECT min(k.t) FROM k WHERE k.joint = j AND k.t > q.t) AS hi FROM q, range(7) s(j)) SELECT a.joint, round(a.t,6)+0.0 AS t, round(CASE WHEN lo IS NULL THEN y.value WHEN hi IS NULL THEN x.value ELSE x.value+(y.value-x.value)*(a.t-lo)/(hi-lo) END,6)+0.0 AS value FROM a LEFT JOIN k x ON x.joint = a.joint AND x.t = lo LEFT JOIN k y ON y.joint = a.joint AND y.t = hi")
def _(spark, d):
    keys = spark.range(35).select((F.col("id") % 7).alias("joint"), F.floor(F.col("id") / 7).cast("double").alias("t"), (F.col("id") * 37 % 11).cast("double").alias("value"))
    times = spark.range(16).select((F.col("id") * 0.37 - 0.5).alias("t"))
    return told(skinning.evaluated_track(keys, times), "joint", "t", "value")


@query("O05_picked_vertices", "SELECT i AS sample_idx, i * 288 // 9 AS vertex_idx FROM range(10) t(i)")
def _(spark, d):
    return skinning.picked(289, 10, spark)


# Contracts.


@query("A40_duplicate_ids", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def _(spark, d):
    return rules.duplicates(spark.read.parquet(f"{d}/events.parquet"), "user_id")


# Frames, walks and exports.


@query("S25_region_lists", f"WITH {_REGION}, c AS (SELECT region::BIGINT AS region, count(*) AS n FROM rg GROUP BY region) SELECT region, n, (sum(n) OVER (ORDER BY region) - n)::BIGINT AS first FROM c")
def _(spark, d):
    return told(coordinates.region_lists(_body(spark)[0].select("region", "node_idx")), "region", "n", "first")
