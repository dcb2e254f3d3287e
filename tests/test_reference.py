"""Fixed expectations: known results on literal shapes, and damaged inputs by rejection code."""

import math

import pytest
from pyspark.sql import functions as F

from voxelry.operators import adf, distance, edits, fields, geometry, particles, sampling, sdf
from voxelry.plans import rules
from voxelry.sources import surfaces


def close(a, b, tolerance=1e-5):
    return abs(a - b) <= tolerance


def test_unit_triangle_grid_and_octree(spark):
    grid = sdf.build(surfaces.unit_triangle(spark), 0.5, 1)
    assert grid.dims == (4, 4, 2) and all(close(o, -0.5) for o in grid.origin)
    r = sdf.diagnostics(grid, 1).first()
    assert (r.sample_count, r.triangle_tests) == (32, 32) and close(r.min_distance, -1.0897248) and close(r.max_distance, 1.0897248)
    field = adf.build(grid, 3, 1024, 0.025)
    s = adf.summary(field).first()
    assert (s.cell_count, s.split_count, s.max_level) == (36, 5, 2) and close(s.min_distance, -1.0897248)


def test_collider_contact(spark):
    surface = geometry.inflated(surfaces.unit_square(spark), 0.05)
    probe = spark.createDataFrame([(0, 0.25, 0.25, 0.1, 0.06)], "point_idx long, x double, y double, z double, radius double")
    r = distance.contacts(probe, surface).first()
    assert close(r.qx, 0.25) and close(r.qz, 0.05) and close(r.distance, 0.05) and r.overlaps


def test_surface_samples_and_tiers(spark):
    s = sampling.samples(surfaces.unit_square(spark), 16, 29791, sampling.LOW_DISCREPANCY).orderBy("sample_idx")
    rows = s.collect()
    assert len(rows) == 16 and all(close(r.b0 + r.b1 + r.b2, 1) and close(r.nz, 1) for r in rows)
    assert all(-1e-9 <= r.x <= 1 + 1e-9 and -1e-9 <= r.y <= 1 + 1e-9 for r in rows)
    n = {r.tier: (r.least, r.most) for r in sampling.tier_counts(sampling.tiers(s.withColumnRenamed("sample_idx", "idx"), 3, 4)).collect()}
    assert n == {1: (3, 3), 2: (4, 4)}


def test_two_particles_interact(spark):
    rows = [(0, -0.05, 0.0, 0.0, 0.0, 0.0, 0.0, 0.02, 1.0, 0.0), (1, 0.05, 0.0, 0.0, 0.0, 0.0, 0.0, 0.02, 1.0, 0.0), (2, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.02, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "particle_idx long, x double, y double, z double, vx double, vy double, vz double, radius double, inverse_mass double, age double")
    out = particles.step(p, 1 / 30, influences=[particles.Influence(0, 0.2, 0, 1, 1)], impulses=[particles.Impulse(0, 0, 0, 0.25, 0, 0.1, 0)], bodies=[particles.Sphere(0, 0, 0, 0.075)], neighbor_radius=0.2, neighbor_strength=1, damping=0, max_speed=10)
    r = {x.particle_idx: x for x in out.collect()}
    assert r[0].checks == r[1].checks == 1 and r[0].collisions == r[1].collisions == 1
    assert all(close(math.hypot(r[k].x, r[k].y, r[k].z), 0.095) for k in (0, 1)) and close(r[0].x, -r[1].x)
    assert (r[2].x, r[2].vx) == (5.0, 1.0) and close(r[2].age, 1 / 30)


def test_fixed_steps():
    assert particles.fixed_steps(0, 0.35, 0.1, 1)[:2] == (1, 2)
    assert particles.fixed_steps(0, -1, 0.1, 4) == (0, 0, 0)


def test_box_pushes_to_the_nearest_face(spark):
    rows = [(0, 0.9, 0.5, 0.5, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    p = spark.createDataFrame(rows, "particle_idx long, x double, y double, z double, vx double, vy double, vz double, radius double, inverse_mass double, age double")
    r = particles.step(p, 1e-6, bodies=[particles.Box((0, 0, 0), (1, 1, 1), 0.5)], damping=0).first()
    assert close(r.x, 1) and close(r.vx, 0.5) and r.collisions == 1


def test_topology_hash(spark):
    r = geometry.topology_key(surfaces.unit_square(spark)).first()
    assert (r.vertex_count, r.triangle_count, int(r.index_hash, 16)) == (4, 2, 16112794849697168423)


def test_distance_in_rings_equals_all_pairs(spark):
    surface = surfaces.wavy_grid(spark, 4)
    points = spark.createDataFrame([(k, (k % 5) / 5 - 0.4, (k // 5) / 5 - 0.4, 0.3 * (k % 3)) for k in range(20)] + [(99, 9.0, 9.0, 9.0)], "point_idx long, x double, y double, z double")
    a = {r.point_idx: r.distance for r in distance.closest_surface(points, surface).collect()}
    b = {r.point_idx: r.distance for r in distance.closest_surface(points, surface, cell=0.25).collect()}
    assert a.keys() == b.keys() and all(close(a[k], b[k], 1e-9) for k in a)


def test_damaged_inputs(spark):
    with pytest.raises(sdf.Rejected, match="sdf.invalid_voxel_size"):
        sdf.build(surfaces.unit_triangle(spark), 0)
    with pytest.raises(sdf.Rejected, match="sdf.voxel_budget_exceeded"):
        sdf.build(surfaces.unit_triangle(spark), 0.01, most=10)
    bad = surfaces.literal(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 9)])
    assert geometry.valid_surface(bad).first().rejection == "mesh.index_out_of_range"
    one = lambda cols, rows: spark.createDataFrame([rows], cols)
    assert rules.checked(one("x double, y double, z double, radius double, strength double", (0.0, 0.0, 0.0, -1.0, 1.0)), rules.influence()).first().rejection == "particle.invalid_influence_config"
    box = one(", ".join(f"{m}_{k} double" for m in ("min", "max") for k in "xyz") + ", restitution double", (1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0))
    assert rules.checked(box, rules.body_box()).first().rejection == "particle.invalid_body_config"
    assert rules.checked(one("dx double, dy double, dz double", (-0.01, 0.0, 0.0)), rules.coordinate_frame()).first().rejection == "mesh.invalid_coordinate_frame_config"
    assert rules.checked(one("time_seconds double, confidence array<double>, joints array<int>", (-1.0, [1.0], [1])), rules.hand_frame()).first().rejection == "mesh.invalid_hand_payload"
    values = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, float("nan"))], "field_id string, node_idx long, value double")
    assert {r.field_id: r.rejection for r in rules.field_buffers(values, 2).collect()} == {"a": None, "b": "field.node_count_mismatch", "c": "field.invalid_field"}
    assert rules.perturbations(one("node_indices array<int>, duration int", ([7], 3)), 7).first().rejection == "field.invalid_perturbation_node"
    assert rules.frequencies(one("frequencies array<double>", ([1.2],))).first().rejection == "field.invalid_field"
    assert rules.rig_weights(spark.createDataFrame([(0, 0, 1, 1.5)], "vertex_idx long, slot int, joint int, weight double"), 4).first().rejection == "mesh.invalid_weight"


EDITS = "circuit_id long, event_idx long, expected_revision long, operation string, target long, amount double, amount2 double, slope double, max_tier int, falloff double, term_id string, start_step int, duration int"


def edited(spark, rows):
    """Edits given as (event, expected revision, operation, target, amount, more...) of one circuit on a path of four nodes."""
    full = [(1, e, r, op, t, v, *more, *(None,) * (7 - len(more))) for e, r, op, t, v, *more in rows]
    nodes = spark.createDataFrame([(1, k, 0.1 * k, 0.0) for k in range(4)], "circuit_id long, node_idx long, voltage double, memory double")
    edges = spark.createDataFrame([(1, k, k, k + 1, 1 + k % 2, 1.0, 1.0, 0.07 if k == 0 else None, 0.1, 0.3, 1.6) for k in range(3)], "circuit_id long, edge_idx long, from_node long, to_node long, tier int, base double, conductance double, threshold double, slope double, low double, high double")
    circuits = spark.createDataFrame([(1, 0, 4, 3, True)], "circuit_id long, revision long, nodes int, edges int, has_memory boolean")
    asked = spark.createDataFrame(full, EDITS)
    results = edits.judged(asked, circuits, edges)
    return sorted((r.event_idx, r.accepted, r.reason, r.revision_before, r.revision_after) for r in results.collect()), edits.accepted(asked, results), nodes, edges


def test_edits_need_the_current_revision(spark):
    got, *_ = edited(spark, [(0, 0, "set_voltage", 0, 1.25), (1, 0, "set_voltage", 0, 1.0), (2, 1, "set_memory", 99, 1.0), (3, None, "set_memory", 1, 1.0), (4, 9, "set_voltage", 0, float("nan")), (5, 2, "set_gate_threshold", 1, 0.5), (6, 2, "set_gate_threshold", 0, 0.5)])
    assert got == [(0, True, None, 0, 1), (1, False, "revision_mismatch", 1, 1), (2, False, "invalid_target", 1, 1), (3, True, None, 1, 2), (4, False, "invalid_value", 2, 2), (5, False, "target_unavailable", 2, 2), (6, True, None, 2, 3)]


def test_a_term_id_is_taken_once(spark):
    term = (None, None, None, None, "t", 0, 5)
    got, accepted, *_ = edited(spark, [(0, None, "transient_current", 0, 1.0, *term), (1, None, "transient_current", 1, 1.0, *term), (2, None, "transient_current", 1, 1.0, None, None, None, None, " ", 0, 5)])
    assert [x[1:3] for x in got] == [(True, None), (False, "target_unavailable"), (False, "invalid_value")]
    assert [(r.term_id, r.current, r.node_idx) for r in edits.added_terms(accepted).collect()] == [("t", 1.0, 0)]


def test_edits_change_values_in_order(spark):
    rows = [(0, None, "set_voltage", 1, 3.0), (1, None, "add_voltage", 1, -0.25), (2, None, "add_neighborhood", 1, -0.5, None, None, 1, 0.5), (3, None, "scale_conductance", 1, 10.0), (4, None, "scale_conductance", 0, 0.5)]
    _, accepted, nodes, edges = edited(spark, rows)
    voltages = edits.applied_voltages(accepted, nodes, edges)
    assert {r.idx: round(r.value, 6) for r in edits.latest(voltages).collect()} == {0: -0.25, 1: 0.25}
    assert {r.event_idx: (r.affected, r.clamped_values) for r in edits.effects(voltages).collect()} == {0: (1, 1), 1: (1, 0), 2: (2, 0)}
    scaled = edits.scaled_conductances(accepted, edges)
    assert {(r.what, r.idx): r.value for r in edits.latest(scaled).collect()} == {(w, k): v for w in ("base", "conductance") for k, v in ((0, 2.0), (1, 4.0))}


def test_perturbations_in_order(spark):
    values = spark.createDataFrame([("f", k, 0.5) for k in range(3)], "field_id string, node_idx long, value double")
    rows = [(2, 0, 0, 5, "depolarize", "f", 0.2), (1, 0, 0, 5, "wound", "f", 0.9), (1, 1, 9, 5, "wound", "f", 0.9), (1, 2, 0, 2, "depolarize", "f", 0.1)]
    schedule = spark.createDataFrame(rows, "ord long, node_idx long, start_step int, duration int, effect string, field_id string, amount double").withColumns({f"p{k}": F.lit(0.0) for k in "xyz"})
    got = {r.node_idx: round(r.value, 6) for r in fields.perturbed_scalars(values, schedule, 1).collect()}
    assert got == {0: 1.1, 1: 0.5, 2: 0.6}


def test_walk_prefers_the_surface(spark):
    """Two sheets one above the other: the nearest along the surface are on one's own."""
    from voxelry.operators import walk

    sheet = [(0, 0), (1, 0), (1, 1), (0, 1)]
    surface = surfaces.literal(spark, [(x, y, z) for z in (0.0, 0.01) for x, y in sheet], [(0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7)])
    samples = sampling.samples(surface, 12, 7)
    got = walk.neighbors(surface, samples, 3).join(samples.select(F.col("sample_idx").alias("from_node"), F.col("z").alias("az")), "from_node").join(samples.select(F.col("sample_idx").alias("to_node"), F.col("z").alias("bz")), "to_node").collect()
    assert len(got) == 36 and all((r.az < 0.005) == (r.bz < 0.005) for r in got)


def test_displacement_stays_in_the_ellipsoid(spark):
    from voxelry.functions.vectors import Vec
    from voxelry.operators import coordinates

    framed = coordinates.frames(sampling.samples(surfaces.unit_square(spark), 4), (0.02, 0.03, 0.04))
    assert all(r.rejection is None for r in rules.checked(framed, rules.local_frame()).collect())
    moved = coordinates.displaced(framed, Vec.lit(0.5, -0.25, 2.0)).join(framed.select("sample_idx", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az")), "sample_idx")
    for r in moved.collect():
        n = math.sqrt(0.25 + 0.0625 + 1)
        assert close(math.dist((r.x, r.y, r.z), (r.ax, r.ay, r.az)), math.sqrt((0.5 * 0.02) ** 2 + (0.25 * 0.03) ** 2 + 0.04**2) / n)


def test_neighbors_by_cells_equal_all_pairs(spark, monkeypatch):
    """Also with points far outside, places shared by many, and fewer points than neighbours."""
    import random

    r = random.Random(3)
    rows = [(k, *(r.choice([r.random(), 0.5]) for _ in range(3))) for k in range(300)] + [(300 + k, 40.0 + k, -30.0, 9.0) for k in range(5)]
    make = lambda x: spark.createDataFrame(x, "idx long, x double, y double, z double")
    for a, b, k, same in ((make(rows), make(rows), 5, True), (make(rows), make(rows[:40]), 3, False), (make(rows[:20]), make(rows[:4]), 9, True), (make(rows[:20]), make([(k, 1.0, 1.0, 1.0) for k in range(9)]), 2, False)):
        told = lambda: sorted((x.a_idx, x.rank, x.b_idx) for x in sampling.nearest(a, b, k, same=same).collect())  # noqa: B023, E731
        want = told()
        with monkeypatch.context() as m:
            m.setattr(sampling, "FEW_POINTS", 0)
            assert told() == want


def test_far_points_look_only_at_near_boxes(spark):
    surface = surfaces.wavy_grid(spark, 12)
    points = spark.createDataFrame([(k, 30.0 * math.cos(k), 20.0 * math.sin(k), k - 5.0) for k in range(10)], "point_idx long, x double, y double, z double")
    a = {r.point_idx: (r.distance, r.tests) for r in distance.closest_surface(points, surface).collect()}
    b = {r.point_idx: (r.distance, r.tests) for r in distance.closest_surface(points, surface, cell=0.1).collect()}
    assert all(close(a[k][0], b[k][0], 1e-9) and b[k][1] < a[k][1] for k in a)


@pytest.mark.parametrize("name", ["J18_F22_adaptive_gradients", "J13_J14_F49_adaptive_samples"])
def test_adaptive_queries_on_gentle_slopes_and_walls_equal_sql(spark, tmp_path, name):
    """Points where the field hardly rises, on walls between cells, outside, and without a place."""
    import duckdb

    from voxelry import catalog, catalog_adaptive  # noqa: F401

    gentle = [(0.16996657848358154, 0.07210586220026016, 0.33448776602745056), (0.1067551001906395, 0.03286849707365036, 0.2808570861816406), (-0.07591184973736716, 0.05863611400127411, 0.31893056631088257)]
    walls = [(x, y, z) for x in (-0.5, -0.375, 0.0, 0.375) for y in (-0.25, 0.0, 0.375) for z in (0.0625, 0.125)]
    odd = [(9.0, 0.0, 0.0), (math.nan, 0.1, 0.02), (math.inf, 0.1, -math.inf), (None, 0.1, 0.02)]
    rows = list(enumerate([list(p) for p in gentle + walls + odd]))
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(at)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/*.parquet'")
        want = db.execute(catalog.ORACLES[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
