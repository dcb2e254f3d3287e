from pyspark.sql import functions as F

from voxelry import catalog
from voxelry.operators import circuit, index, particles, runs, runtime, scenario
from voxelry.sources import artifacts, surfaces


def test_runs_agree_with_single_steps(spark):
    """Three steps of a scenario as arrays, and as joins and aggregates."""
    mapped, tiers = catalog._body(spark)
    name = "transient_memory"
    state, edges, terms = scenario.initial_state(mapped, name), scenario.scenario_edges(tiers, mapped, name), scenario.scenario_terms(mapped, name)
    gate, memory = circuit.Gate(*scenario.GATE), circuit.Memory(*scenario.MEMORY)
    one = lambda df: df.withColumn("circuit_id", F.lit(7).cast("bigint"))
    frames = runs.run(one(state), one(edges), one(terms), 3, 1, gate, memory)
    got = {(r.step, r.node_idx): (r.voltage, r.memory, r.head) for r in frames.collect()}
    links = edges
    for k in range(3):
        state, links = circuit.step(state, links, terms, k, gate, memory, circuit.Readout(1.5, 0.7, 0.5, 2.0, 0.0, 1.0), circuit.Config(dt=1 / 30))
        rows = state.select("node_idx", "voltage", "memory", "readout").collect()
        assert all(abs(a - b) < 1e-9 for r in rows for a, b in zip(got[k + 1, r.node_idx], (r.voltage, r.memory, r.readout), strict=True))
        state = spark.createDataFrame(rows, "node_idx long, voltage double, memory double, readout double")
    assert len(got) == 4 * 261


def test_the_transient_leaves_a_memory(spark):
    frames, mapped, edges = catalog._runs(spark)
    rows = scenario.trace_set(frames, mapped, edges).collect()
    at = {(r.scenario, r.step): r for r in rows}
    assert len(rows) == 5 * 11 and {s for _, s in at} == set(range(0, 151, 15))
    last = {k: at[k, 150] for k in scenario.SCENARIOS}
    assert last["transient_memory"].posterior_memory > 0.5 > last["baseline"].posterior_memory
    assert last["transient_no_memory_control"].posterior_memory == 0
    assert last["transient_memory"].posterior_head > last["transient_no_memory_control"].posterior_head
    assert last["gap_block"].cut_conductance < 0.1 * last["baseline"].cut_conductance
    # A circuit without nodes in a group gives nothing; a huge one is refused before it is run.
    assert frames.filter("circuit_id is null").isEmpty()


def test_index_tree_covers_every_triangle_once(spark):
    surface = surfaces.wavy_grid(spark, 5)
    leaves = index.tree(surface, 4).collect()
    assert sorted(r.tri_idx for r in leaves) == list(range(50)) and sorted(r.pos for r in leaves) == list(range(50))
    sizes = {}
    for r in leaves:
        sizes.setdefault(r.node, []).append(r.tri_idx)
    assert all(len(x) <= 4 for x in sizes.values())
    one = index.tree(surfaces.unit_triangle(spark), 8).collect()
    assert [(r.node, r.depth) for r in one] == [(1, 0)]


def test_frames_that_are_invalid_change_nothing(spark):
    rows = [(1, 0, None, True), (1, 1, "a", True), (1, 2, None, True), (1, 3, "a", False), (1, 4, "b", True)]
    frames = spark.createDataFrame(rows, "sequence_id long, frame_idx long, topology string, collider boolean")
    got = [(r.sampler, r.collider, r.refit) for r in runtime.update_outcomes(frames).orderBy("frame_idx").collect()]
    assert got == [("invalid_surface", "invalid_surface", False), ("initialized", "initialized", False), ("invalid_surface", "invalid_surface", False), ("updated", "disabled", True), ("resampled_topology", "changed_topology", False)]


def test_force_probe_counts_what_it_passes_over(spark):
    p = spark.createDataFrame([(k, 0.1 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 1.0, 0.0) for k in range(8)], ", ".join(f"{c} {'long' if c == 'particle_idx' else 'double'}" for c in particles.COLUMNS))
    force = spark.createDataFrame([(k, 0.5, 1.0, 0.0, 0.0) for k in (1, 3, 4, 7)], "particle_idx long, distance double, ox double, oy double, oz double")
    take = lambda n: [(r.particle_idx, r.rejected) for r in runtime.force_probe(p, force, n).orderBy("particle_idx").collect()]
    assert take(2) == [(1, 2), (3, 2)] and take(9) == [(1, 4), (3, 4), (4, 4), (7, 4)]


def test_tables_keep_to_the_catalog(spark):
    assert artifacts.catalog_differences(surfaces.wavy_grid(spark, 2).vertices, "voxelry.mesh.vertices.table.v1") == []
    assert artifacts.catalog_differences(spark.range(1), "voxelry.fields.scalars.table.v1") == ["field_id", "node_idx", "value"]
