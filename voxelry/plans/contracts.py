"""Contracts in SQL: what must hold of a row, or of all rows of one key, and the rejection code.

A contract is a list of rules in order; the first one that does not hold gives the code, and
a rule that is null does not hold.  Rules of whole sets (an id given twice, a count that
differs) are rules over the totals of a key, so they cost one aggregation, whatever a set's
size.  Texts in lists come as rows, one for each.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import DOTTED, first_broken

INF = "CAST('Infinity' AS DOUBLE)"


def finite(*columns: str) -> str:
    return " AND ".join(f"abs({c}) < {INF}" for c in columns)


def at_least(low: float, *columns: str) -> str:
    return " AND ".join(f"(abs({c}) < {INF} AND {c} >= {low!r})" for c in columns)


def above_zero(*columns: str) -> str:
    return " AND ".join(f"(abs({c}) < {INF} AND {c} > 0)" for c in columns)


def filled(*columns: str) -> str:
    return " AND ".join(f"trim({c}) <> ''" for c in columns)


def sha256(*columns: str) -> str:
    return " AND ".join(f"REGEXP({c}, '^[0-9a-fA-F]{{64}}$')" for c in columns)


# Where public files lie, and what must not show in a path or a policy text.
PUBLIC_ROOTS = ("/data/bridges/", "/data/source-maps/", "/data/replays/", "/assets/geometry/", "/assets/bioelectricity/")
PRIVATE_FRAGMENTS = ("raw/", "/raw/", "artifacts/", "/artifacts/", ".togo", ".am.dat", ".am.lda", ".am", "tileminmax", "decoder", "key material", ".log", "review packet", "source request package")
BLOCKED_OUTPUTS = ("observed_dynamics_binding", "measured_bioelectric_state", "predictive_regeneration_output", "live_matter_stepping", "edit_acceptance")
REQUIRED_INPUTS = ("bridge_manifest", "geometry_glb", "source_map_sidecar", "replay_manifest", "preview_gif")
REQUIRED_TARGETS = ("ap_transient_memory", "gap_block_conductance", "head_vs_tail_voltage")
BASES = ("right_handed_y_up_negative_z_forward", "right_handed_y_up_positive_z_forward")


def open_text(c: str) -> str:
    """No private fragment and no sign of a local path."""
    return f"NOT contains({c}, chr(92)) AND NOT contains({c}, ':') AND " + " AND ".join(f"NOT contains(lower({c}), '{w}')" for w in PRIVATE_FRAGMENTS)


def public_path(c: str) -> str:
    rooted = " OR ".join(f"left({c}, {len(r)}) = '{r}'" for r in PUBLIC_ROOTS)
    return f"{filled(c)} AND {open_text(c)} AND NOT REGEXP({c}, '(^|/)[.][.](/|$)') AND ({rooted})"


class Contract(NamedTuple):
    """``keys`` and ``totals``: for rules of sets, what to group by and the aggregates by name."""

    rules: tuple[tuple[str, str], ...]
    keys: tuple[str, ...] = ()
    totals: tuple[tuple[str, str], ...] = ()

    def rejections(self, df: DataFrame, *columns: str) -> DataFrame:
        """The given columns (or the keys) and ``rejection``, null where all rules hold."""
        if self.keys:
            df = df.groupBy(*self.keys).agg(*[F.expr(spark_sql(e)).alias(n) for n, e in self.totals])
        return df.select(*(columns or self.keys), first_broken([(code, F.expr(spark_sql(holds))) for code, holds in self.rules]).alias("rejection"))


def spark_sql(text: str) -> str:
    return text.replace("REGEXP(", "regexp_like(").replace("left_of(", "left(")


def _once(n: str = "n", distinct: str = "d") -> str:
    return f"{n} = {distinct}"


BARYCENTRIC = " AND ".join(f"b{k} BETWEEN -1e-5 AND 1.00001e0" for k in range(3)) + " AND abs(b0 + b1 + b2 - 1) <= 1e-4"
_UNIT = " AND ".join(f"abs(sqrt({a}x*{a}x+{a}y*{a}y+{a}z*{a}z) - 1) <= 1e-3" for a in "uvw")
_SQUARE = " AND ".join(f"abs({a}x*{b}x+{a}y*{b}y+{a}z*{b}z) <= 1e-3" for a, b in ("uv", "vw", "uw"))
_BOX = " AND ".join(f"min_{k} <= max_{k}" for k in "xyz")
_ENDS = finite(*[f"{m}_{k}" for m in ("min", "max") for k in "xyz"])

CONTRACTS: dict[str, Contract] = {
    # Model.
    "bounds": Contract((("model.non_finite_point", _ENDS), ("model.invalid_bounds", _BOX))),
    "padding": Contract((("model.invalid_bounds", at_least(0.0, "padding")),)),
    "snapshot_mesh": Contract(
        (("model.empty_mesh", "n > 0"), ("model.degenerate_triangle", "repeated = 0"), ("model.index_out_of_range", "low >= 0 AND high < vertices")),
        ("mesh_id",), (("n", "count(*)"), ("repeated", "sum(CASE WHEN a = b OR b = c OR a = c THEN 1 ELSE 0 END)"), ("low", "min(least(a, b, c))"), ("high", "max(greatest(a, b, c))"), ("vertices", "max(vertex_count)")),
    ),
    "surface_area": Contract((("mesh.no_area", f"{finite('area')} AND area > 1e-9"),), ("mesh_id",), (("area", "sum(area)"),)),
    "schema_id": Contract((("model.invalid_id", f"REGEXP(id, '{DOTTED}')"), ("model.invalid_schema_prefix", "left(id, 8) = 'voxelry.'"), ("model.invalid_schema_segments", "length(id) - length(replace(id, '.', '')) >= 4"), ("model.invalid_schema_version", "REGEXP(id, '[.]v[1-9][0-9]*$')"))),
    "dotted_id": Contract((("model.invalid_id", f"REGEXP(id, '{DOTTED}')"),)),
    # Meshes.
    "source_descriptor": Contract((("mesh.empty_mesh_source_id", filled("source_id")), ("mesh.invalid_mesh_source_descriptor", f"{filled('source_format', 'source_hash', 'license', 'attribution')} AND {above_zero('unit_scale')} AND {filled('axis_convention')} AND REGEXP(note, '^[ -~]*$')"))),
    "surface_sample": Contract((("mesh.invalid_sample", f"{finite('x', 'y', 'z', 'nx', 'ny', 'nz')} AND nx*nx+ny*ny+nz*nz > 1e-10 AND {BARYCENTRIC}"),)),
    "sample_set": Contract(
        (("mesh.neighbor_out_of_range", "low >= 0 AND high < samples"), ("mesh.self_neighbor", "own = 0"), ("mesh.duplicate_neighbor", _once())),
        ("from_node",), (("low", "min(to_node)"), ("high", "max(to_node)"), ("samples", "max(samples)"), ("own", "sum(CASE WHEN to_node = from_node THEN 1 ELSE 0 END)"), ("n", "count(*)"), ("d", "count(DISTINCT to_node)")),
    ),
    "cross_neighborhood": Contract(
        (("mesh.neighbor_out_of_range", "low >= 0 AND high < others"), ("mesh.too_many_neighbors", "n <= most"), ("mesh.duplicate_neighbor", _once())),
        ("a_idx",), (("low", "min(b_idx)"), ("high", "max(b_idx)"), ("others", "max(others)"), ("most", "max(most)"), ("n", "count(*)"), ("d", "count(DISTINCT b_idx)")),
    ),
    "local_frame": Contract((("mesh.axis_length", _UNIT), ("mesh.axis_angle", _SQUARE))),
    "coordinate_map": Contract((("mesh.empty_coordinate_map_id", filled("map_id")), ("mesh.topology_mismatch", "map_key = surface_key AND sample_key = map_key AND frame_key = map_key"), ("mesh.surface_mismatch", "sample_surface = surface_id"), ("mesh.invalid_coordinate_frame_config", at_least(0.0, "dx", "dy", "dz")), ("mesh.frame_count_mismatch", "frames = samples"))),
    "package": Contract((("mesh.empty_package_id", filled("package_id")), ("mesh.invalid_package", "source_ok AND surface_ok AND map_ok"), ("mesh.invalid_package_note", "REGEXP(note, '^[ -~]*$')"))),
    "coordinate_frame": Contract((("mesh.invalid_coordinate_frame_config", at_least(0.0, "dx", "dy", "dz")),)),
    "collider": Contract((("mesh.invalid_collider_config", at_least(0.0, "inflation", "padding", "shell")),)),
    "rig": Contract(
        (("mesh.invalid_hand_payload", "low >= 0 AND high < joints AND finite_n = n AND least >= 0 AND total <= 1.0001e0"),),
        ("vertex_idx",), (("low", "min(joint)"), ("high", "max(joint)"), ("joints", "max(joints)"), ("least", "min(weight)"), ("total", "sum(weight)"), ("n", "count(*)"), ("finite_n", f"sum(CASE WHEN {finite('weight')} THEN 1 ELSE 0 END)")),
    ),
    "joint_frame": Contract(
        (("mesh.invalid_hand_payload", f"{at_least(0.0, 'time_seconds')} AND n > 0 AND poses_ok = n AND (confident = 0 OR (confident = n AND least >= 0 AND most <= 1))"),),
        ("frame",), (("time_seconds", "max(time_seconds)"), ("n", "count(*)"), ("poses_ok", f"sum(CASE WHEN {finite('x', 'y', 'z')} THEN 1 ELSE 0 END)"), ("confident", "count(confidence)"), ("least", "min(confidence)"), ("most", "max(confidence)")),
    ),
    "validation_frame": Contract((("mesh.empty_hand_frame_id", filled("frame_id")), ("mesh.invalid_hand_payload", f"{filled('reference_space', 'source')} AND {at_least(0.0, 'time_seconds')} AND topology_key = surface_key AND (normals = 0 OR normals = vertices)"))),
    "hand_substrate": Contract((("mesh.invalid_hand_payload", f"{filled('conformance_id', 'provider_id', 'frame_id')} AND basis IN {BASES!r} AND rig_source = provider_id AND frame_source = provider_id AND rig_side = frame_side AND joints = poses"),)),
    # Distance fields.
    "sdf_config": Contract((("sdf.invalid_voxel_size", above_zero("voxel_size")), ("sdf.invalid_voxel_budget", "max_voxels > 0"))),
    "packed_grid": Contract(
        (("sdf.zero_dimension", "nx > 0 AND ny > 0 AND nz > 0"), ("sdf.distance_count_mismatch", "n = nx * ny * nz"), ("sdf.non_finite_distance", "ok = n")),
        ("grid_id",), (("nx", "max(nx)"), ("ny", "max(ny)"), ("nz", "max(nz)"), ("n", "count(*)"), ("ok", f"sum(CASE WHEN {finite('distance')} THEN 1 ELSE 0 END)")),
    ),
    "adf_config": Contract((("adf.invalid_max_depth", "max_depth BETWEEN 0 AND 16"), ("adf.invalid_max_cells", "max_cells > 0"), ("adf.invalid_tolerance", at_least(0.0, "tolerance")))),
    "adf_cell": Contract((("adf.non_finite_cell", finite("ox", "oy", "oz", "extent", "center_distance", "min_distance", "max_distance")), ("adf.invalid_cell", "extent > 0 AND level BETWEEN 0 AND max_depth AND min_distance <= max_distance AND sample_count > 0"))),
    "adf_field": Contract(
        (("adf.invalid_extent", "least > 0"), ("adf.invalid_max_depth", "depth <= 16"), ("adf.empty_cells", "cells > 0"), ("adf.invalid_cell", "deepest <= depth")),
        ("field_id",), (("least", "min(extent)"), ("depth", "max(max_depth)"), ("cells", "count(level)"), ("deepest", "max(level)")),
    ),
    # Particles.
    "particle": Contract((("particle.empty_particle_id", filled("particle_id")), ("particle.non_finite_position", finite("x", "y", "z")), ("particle.non_finite_velocity", finite("vx", "vy", "vz")), ("particle.invalid_radius", at_least(0.0, "radius")), ("particle.invalid_inverse_mass", at_least(0.0, "inverse_mass")), ("particle.invalid_age", at_least(0.0, "age")))),
    "particle_set": Contract((("particle.empty_set_id", filled("set_id")), ("particle.invalid_set_time", at_least(0.0, "time_seconds")), ("particle.invalid_radius", "broken = 0")), ("set_id",), (("time_seconds", "max(time_seconds)"), ("broken", f"sum(CASE WHEN {at_least(0.0, 'radius')} THEN 0 ELSE 1 END)"))),
    "fixed_step": Contract((("particle.empty_step_config_id", filled("config_id")), ("particle.invalid_fixed_step", above_zero("step_seconds")), ("particle.invalid_max_steps", "max_steps > 0"), ("particle.invalid_neighbor_config", at_least(0.0, "neighbor_radius", "neighbor_strength")))),
    "influence": Contract((("particle.invalid_influence_config", f"{finite('x', 'y', 'z', 'strength')} AND {at_least(0.0, 'radius')}"),)),
    "impulse": Contract((("particle.invalid_impulse_config", f"{finite('x', 'y', 'z', 'dx', 'dy', 'dz')} AND {at_least(0.0, 'radius')}"),)),
    "body": Contract((("particle.invalid_body_config", f"{at_least(0.0, 'restitution')} AND ((shape = 'sphere' AND {at_least(0.0, 'radius')}) OR (shape = 'box' AND {_ENDS} AND {_BOX}))"),)),
    "render_payload": Contract(
        (("particle.invalid_set_time", at_least(0.0, "time_seconds")), ("particle.invalid_render_payload", "(n = 0 AND given = 0) OR (n > 0 AND given = 1 AND ordered = 1)")),
        ("payload_id",), (("time_seconds", "max(time_seconds)"), ("n", "count(sample_idx)"), ("given", "max(CASE WHEN min_x IS NULL THEN 0 ELSE 1 END)"), ("ordered", f"min(CASE WHEN {_BOX} THEN 1 ELSE 0 END)")),
    ),
    # Fields.
    "field_buffers": Contract(
        (("field.node_count_mismatch", "n = nodes AND d = nodes"), ("field.non_finite_scalar", "ok = n")),
        ("field_id",), (("n", "count(*)"), ("d", "count(DISTINCT node_idx)"), ("nodes", "max(nodes)"), ("ok", f"sum(CASE WHEN {finite('value')} THEN 1 ELSE 0 END)")),
    ),
    "perturbation": Contract(
        (("field.invalid_perturbation_node", "low >= 0 AND high < nodes"), ("field.duplicate_perturbation_node", _once()), ("field.invalid_perturbation", "duration > 0 AND ok = n")),
        ("perturbation_id",), (("low", "min(node_idx)"), ("high", "max(node_idx)"), ("nodes", "max(nodes)"), ("n", "count(*)"), ("d", "count(DISTINCT node_idx)"), ("duration", "max(duration)"), ("ok", f"sum(CASE WHEN {finite('amount')} THEN 1 ELSE 0 END)")),
    ),
    "field_runtime": Contract((("field.empty_runtime_config_id", filled("config_id")), ("field.invalid_runtime_config", f"{above_zero('step_seconds')} AND max_steps > 0 AND neighbor_tiers BETWEEN 1 AND 2 AND {finite('clamp_low', 'clamp_high')} AND clamp_low < clamp_high AND {above_zero('vector_length')} AND {at_least(0.0, 'diffusion', 'decay', 'alignment', 'gradient')} AND second_tier BETWEEN 0 AND 1"))),
    "dynamics_plan": Contract(
        (("field.invalid_neighbor", "low >= 0 AND high < nodes"), ("field.self_neighbor", "own = 0"), ("field.invalid_runtime_config", "least_tier >= 1 AND most_tier <= enabled AND weights_ok = n AND n = links")),
        ("plan_id",), (("low", "min(least(from_node, to_node))"), ("high", "max(greatest(from_node, to_node))"), ("nodes", "max(nodes)"), ("own", "sum(CASE WHEN from_node = to_node THEN 1 ELSE 0 END)"), ("least_tier", "min(tier)"), ("most_tier", "max(tier)"), ("enabled", "max(enabled)"), ("weights_ok", f"sum(CASE WHEN {above_zero('weight')} THEN 1 ELSE 0 END)"), ("n", "count(*)"), ("links", "max(links)")),
    ),
    "field_node": Contract((("field.empty_node_id", filled("node_id")), ("field.invalid_substrate", f"node_idx = expected_idx AND {finite('x', 'y', 'z')} AND {BARYCENTRIC}"))),
    # Circuits.
    "circuit_state": Contract(
        (("field.invalid_field", f"n > 0 AND {at_least(0.0, 'time_seconds')}"), ("field.duplicate_field_id", "n = ids"), ("field.duplicate_neighbor", "n = edges"), ("field.invalid_neighbor", "low >= 0 AND high < nodes AND own = 0")),
        ("circuit_id",), (("n", "count(edge_id)"), ("time_seconds", "max(time_seconds)"), ("ids", "count(DISTINCT edge_id)"), ("edges", "count(DISTINCT concat_ws('/', CAST(from_node AS STRING), CAST(to_node AS STRING), CAST(tier AS STRING)))"), ("low", "min(least(from_node, to_node))"), ("high", "max(greatest(from_node, to_node))"), ("nodes", "max(nodes)"), ("own", "sum(CASE WHEN from_node = to_node THEN 1 ELSE 0 END)")),
    ),
    "circuit_config": Contract((("field.empty_runtime_config_id", filled("config_id")), ("field.invalid_runtime_config", f"{above_zero('step_seconds')} AND max_steps > 0 AND {finite('v_low', 'v_high')} AND v_low < v_high AND {at_least(0.0, 'g_low', 'g_high')} AND g_low <= g_high AND {above_zero('current')}"))),
    "circuit_edit": Contract((("field.invalid_field", f"{filled('edit_id')} AND {finite('amount')} AND (operation <> 'scale_conductance' OR amount >= 0) AND (operation <> 'set_gate_bounds' OR (amount >= 0 AND {finite('amount2')} AND amount <= amount2)) AND (operation <> 'set_gate_threshold' OR slope IS NULL OR ({finite('slope')} AND slope <> 0)) AND (operation <> 'transient_current' OR duration > 0)"), ("field.invalid_perturbation_node", "target >= 0 AND target < targets"))),
    "edit_result": Contract((("field.invalid_run_summary", f"{filled('result_id', 'edit_id')} AND ((accepted AND reason IS NULL AND revision_after > revision_before) OR (NOT accepted AND trim(reason) <> '' AND revision_after = revision_before))"),)),
    "debug_sequence": Contract(
        (("field.invalid_run_summary", f"{above_zero('step_seconds')} AND stride > 0 AND n > 0 AND n = d AND first = 0 AND last = steps"),),
        ("sequence_id",), (("step_seconds", "max(step_seconds)"), ("stride", "max(stride)"), ("n", "count(*)"), ("d", "count(DISTINCT step)"), ("first", "min(step)"), ("last", "max(step)"), ("steps", "max(steps)")),
    ),
    "run_summary": Contract((("field.empty_run_summary_id", filled("summary_id")), ("field.invalid_run_summary", f"nodes > 0 AND scalar_fields + vector_fields > 0 AND ((low IS NULL AND high IS NULL) OR ({finite('low', 'high')} AND low <= high)) AND (longest IS NULL OR {at_least(0.0, 'longest')})"))),
    "step_diagnostics": Contract((("field.invalid_run_summary", "active_terms <= terms AND active_gates <= edges AND clamped <= nodes AND " + at_least(0.0, "largest")),)),
    # Body axes, scenarios, traces.
    "axis_map": Contract(
        (("field.node_count_mismatch", "n = nodes"), ("field.invalid_field", "wrong = 0 AND regions = 5")),
        ("map_id",), (("n", "count(*)"), ("nodes", "max(nodes)"), ("wrong", "sum(CASE WHEN region = 1 + (CASE WHEN nz >= -62e-2 THEN 1 ELSE 0 END) + (CASE WHEN nz >= -18e-2 THEN 1 ELSE 0 END) + (CASE WHEN nz >= 24e-2 THEN 1 ELSE 0 END) + (CASE WHEN nz >= 66e-2 THEN 1 ELSE 0 END) THEN 0 ELSE 1 END)"), ("regions", "count(DISTINCT region)")),
    ),
    "scenario_run": Contract((("field.invalid_run_summary", filled("run_id", "evidence_type", "expected_outcome")), ("field.invalid_substrate", "surface_id = substrate_surface AND surface_key = substrate_key"), ("field.invalid_run_summary", f"circuit_substrate = substrate_id AND sequence_substrate = substrate_id AND sequence_circuit = circuit_id AND abs(sequence_dt - circuit_dt) <= 1e-7 AND {filled('anchor')}"))),
    "trace_set": Contract(
        (("field.invalid_runtime_config", above_zero("least_dt")), ("field.invalid_run_summary", "stride > 0 AND n = scenarios AND substrates = 1 AND surfaces = 1 AND strides = 1 AND least_dt = most_dt")),
        ("set_id",), (("n", "count(*)"), ("scenarios", "count(DISTINCT scenario)"), ("substrates", "count(DISTINCT substrate_id)"), ("surfaces", "count(DISTINCT surface_id)"), ("stride", "min(stride)"), ("strides", "count(DISTINCT stride)"), ("least_dt", "min(dt)"), ("most_dt", "max(dt)")),
    ),
    "morphology": Contract(
        (("field.invalid_run_summary", "anchors > 0 AND n = 5 AND d = 5"), ("field.invalid_field", "low >= 0 AND high <= 1 AND abs(total - 1) <= 1e-3")),
        ("metrics_id",), (("anchors", "count(anchor)"), ("n", "count(*)"), ("d", "count(DISTINCT region)"), ("low", "min(least(fraction, ap_min, ap_max))"), ("high", "max(greatest(fraction, ap_min, ap_max))"), ("total", "sum(fraction)")),
    ),
    # Evidence documents.
    "dynamics_target": Contract((("field.invalid_run_summary", f"{filled('target_id')} AND contains(anchor, concat('target:', target_id)) AND contains(blocked_use, 'calibrated physiology') AND (source_id <> 'planformdb_250' OR left(record_id, 22) = 'planformdb:experiment:')"),)),
    "dynamics_targets": Contract((("field.invalid_run_summary", "n = d AND required = 3 AND contains(policy, 'not calibrated')"),), ("fixture_id",), (("n", "count(*)"), ("d", "count(DISTINCT target_id)"), ("required", f"count(DISTINCT CASE WHEN target_id IN {REQUIRED_TARGETS!r} THEN target_id END)"), ("policy", "max(policy)"))),
    "bridge": Contract((("field.invalid_run_summary", filled("fixture_id", "bridge_id", "doi", "run_id")), ("field.invalid_hash", sha256("manifest_sha256", "map_sha256")), ("field.invalid_path", public_path("path")), ("field.invalid_counts", "elements > 0 AND elements = mapped AND replay_nodes > 0 AND replay_edges > 0 AND replay_frames > 0"))),
    "bridge_inputs": Contract((("field.duplicate_input", "n = d"), ("field.missing_input", f"required = {len(REQUIRED_INPUTS)}")), ("fixture_id",), (("n", "count(*)"), ("d", "count(DISTINCT kind)"), ("required", f"count(DISTINCT CASE WHEN kind IN {REQUIRED_INPUTS!r} THEN kind END)"))),
    "bridge_policy": Contract((("field.invalid_policy_text", f"{filled('policy')} AND {open_text('policy')}"),)),
    "substrate_request": Contract((("field.invalid_run_summary", filled("request_id", "bridge_id")), ("field.invalid_counts", "elements > 0 AND elements = nodes"), ("field.invalid_graph_policy", "status = 'request_only_not_materialized' AND neighbors BETWEEN 1 AND 12 AND contains(weights, 'not conductance') AND contains(weights, 'not voltage')"))),
    "substrate_outputs": Contract(
        (("field.invalid_policy_text", "named = 2"), ("field.blocked_output", f"blocked = {len(BLOCKED_OUTPUTS)} AND allowed_blocked = 0")),
        ("request_id",), (("named", "count(DISTINCT CASE WHEN allowed AND output IN ('display_substrate_graph_fixture', 'source_map_node_index') THEN output END)"), ("blocked", f"count(DISTINCT CASE WHEN NOT allowed AND output IN {BLOCKED_OUTPUTS!r} THEN output END)"), ("allowed_blocked", f"sum(CASE WHEN allowed AND output IN {BLOCKED_OUTPUTS!r} THEN 1 ELSE 0 END)")),
    ),
    "public_path": Contract((("field.invalid_path", public_path("path")),)),
    "hash": Contract((("field.invalid_hash", sha256("hash")),)),
    "derived_record": Contract((("field.invalid_run_summary", "record_id = concat('planformdb:experiment:', CAST(experiment AS STRING), ':resultset:', CAST(resultset AS STRING))"), ("field.invalid_field", "low >= 0 AND high <= 1 AND abs(total - 1) <= 1e-3")), ("record_id", "experiment", "resultset"), (("low", "min(frequency)"), ("high", "max(frequency)"), ("total", "sum(frequency)"))),
    "derived_fixture": Contract((("field.invalid_run_summary", "citations >= 2 AND cited = 1 AND records = d"),), ("fixture_id",), (("citations", "count(DISTINCT citation)"), ("cited", "max(CASE WHEN citation = 'lobo_2013_planform' THEN 1 ELSE 0 END)"), ("records", "count(record_id)"), ("d", "count(DISTINCT record_id)"))),
    "head_taxonomy": Contract((("field.invalid_run_summary", "n = d AND teaching = 1 AND contains(policy, 'no paper figure reuse')"),), ("taxonomy_id",), (("n", "count(*)"), ("d", "count(DISTINCT label_id)"), ("teaching", "max(CASE WHEN label_id = 'unclassified_teaching_abstraction' THEN 1 ELSE 0 END)"), ("policy", "max(policy)"))),
    # The surface runtime.
    "surface_runtime": Contract((("runtime.empty_runtime_id", filled("runtime_id")), ("runtime.empty_particle_set_id", filled("set_id")), ("mesh.invalid_collider_config", at_least(0.0, "inflation", "padding", "shell")), ("sdf.invalid_voxel_size", above_zero("voxel_size")), ("adf.invalid_max_depth", "max_depth BETWEEN 0 AND 16"))),
    "particle_reset": Contract((("runtime.invalid_particle_count", "particles BETWEEN 0 AND 32768"), ("runtime.invalid_particle_reset", at_least(0.0, "cloud_radius", "particle_radius", "surface_radius")))),
    "frame_input": Contract((("runtime.invalid_frame_time", at_least(0.0, "time_seconds")),)),
}
