"""Queries of the contracts, over inputs of which some break each rule.

The inputs are made from ``events`` by SQL expressions, so DuckDB can make the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .plans.contracts import BASES, BLOCKED_OUTPUTS, CONTRACTS, PUBLIC_ROOTS, REQUIRED_INPUTS, REQUIRED_TARGETS, spark_sql

NAN, INFINITE = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"


def but(good: str, bad: str, r: int, of: int = 41) -> str:
    """The good value, but for every ``of``-th event."""
    return f"CASE WHEN event_id % {of} = {r} THEN {bad} ELSE {good} END"


def pick(*values: str, by: str = "event_id") -> str:
    rows = " ".join(f"WHEN {by} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {rows} END"


def duck(text: str) -> str:
    return text.replace("REGEXP(", "regexp_matches(").replace("AS STRING", "AS VARCHAR")


def contract(name: str, which: str, inputs: dict[str, str], show: tuple[str, ...] = ("event_id",), where: str = "true") -> None:
    c = CONTRACTS[which]
    cols = ", ".join([*([] if c.keys else ["event_id"]), *[f"{e} AS {k}" for k, e in inputs.items() if k != "event_id"]])
    case = "CASE " + " ".join(f"WHEN NOT coalesce({holds}, false) THEN '{code}'" for code, holds in c.rules) + " END AS rejection"
    if c.keys:
        keys = ", ".join(c.keys)
        sql = f"WITH i AS (SELECT {cols} FROM events WHERE {where}), g AS (SELECT {keys}, {', '.join(f'{e} AS {n}' for n, e in c.totals if n not in c.keys)} FROM i GROUP BY {keys}) SELECT {keys}, {case} FROM g"
        show = c.keys
    else:
        sql = f"WITH i AS (SELECT {cols} FROM events WHERE {where}) SELECT {', '.join(show)}, {case} FROM i"

    @query(name, duck(sql))
    def _(spark, d):
        e = spark.read.parquet(f"{d}/events.parquet").filter(where)
        made = e.select(*([] if c.keys else ["event_id"]), *[F.expr(spark_sql(x)).alias(k) for k, x in inputs.items() if k != "event_id"])
        return c.rejections(made, *show)


XYZ = {"x": but("value", NAN, 1), "y": "2e0", "z": but("3e0", INFINITE, 2)}
ID = {"n": "CAST(event_id % 9 AS STRING)"}


def text(r: int, good: str = "'some.id'") -> str:
    return but(good, "'  '", r)


BOX = {"min_x": "0e0", "min_y": but("0e0", "2e0", 3), "min_z": but("0e0", NAN, 4), "max_x": but("1e0", "-1e0", 5), "max_y": "1e0", "max_z": "1e0"}

contract("P03_bounds", "bounds", BOX)
contract("P04_padding", "padding", {"padding": but(but("value", "-1e0", 6), INFINITE, 7)})
contract("P01_snapshot_mesh", "snapshot_mesh", {"mesh_id": "event_id % 97", "a": "event_id % 11", "b": "event_id % 11 + 1", "c": but("event_id % 11 + 2", "event_id % 11", 8, 391), "vertex_count": "CASE WHEN event_id % 97 < 60 THEN 13 ELSE 12 END"})
contract("P02_surface_area", "surface_area", {"mesh_id": "event_id % 97", "area": "CASE WHEN event_id % 97 < 9 THEN 0e0 WHEN event_id % 97 < 14 THEN CAST('NaN' AS DOUBLE) ELSE value END"})
contract("P06_dotted_ids", "dotted_id", {"id": pick("a.b", "A.b", "a-1.b_2", "a..b", "-a", "a.b-", "")})
contract("P05_schema_ids", "schema_id", {"id": pick("voxelry.mesh.vertices.table.v1", "other.mesh.vertices.table.v1", "voxelry.mesh.v1", "voxelry.mesh.vertices.table.v0", "voxelry.Mesh.vertices.table.v1", "voxelry.mesh.vertices.table.v12")})
contract("P07_source_descriptor", "source_descriptor", {"source_id": text(1), "source_format": text(2, "'glb'"), "source_hash": "'ab12'", "license": text(3, "'free'"), "attribution": "'somebody'", "unit_scale": but("1e0", "0e0", 4), "axis_convention": "'y_up'", "note": but("'plain'", "'café'", 5)})
_BARY = {"b0": but("0.25e0", "-0.1e0", 6), "b1": but("0.25e0", "0.5e0", 7), "b2": "0.5e0"}
contract("P08_surface_samples", "surface_sample", {**XYZ, "nx": "0e0", "ny": "0e0", "nz": but("1e0", "0e0", 8), **_BARY})
contract("P09_sample_neighbors", "sample_set", {"from_node": "event_id % 503", "to_node": but("(event_id * 7) % 503", "event_id % 503", 9, 977), "samples": "500"})
contract("P10_cross_neighborhood", "cross_neighborhood", {"a_idx": "event_id % 499", "b_idx": "(event_id * 13) % 811", "others": "805", "most": "20"})
contract("P11_local_frame", "local_frame", {"ux": but("1e0", "1.1e0", 1), "uy": "0e0", "uz": "0e0", "vx": but("0e0", "0.6e0", 2), "vy": but("1e0", "0.8e0", 2), "vz": "0e0", "wx": "0e0", "wy": "0e0", "wz": but("1e0", NAN, 3)})
contract("P12_coordinate_map", "coordinate_map", {"map_id": text(1), "map_key": "event_id % 7", "surface_key": but("event_id % 7", "9", 2), "sample_key": but("event_id % 7", "9", 3), "frame_key": "event_id % 7", "sample_surface": "'s'", "surface_id": but("'s'", "'t'", 4), "dx": but("0.1e0", "-0.1e0", 5), "dy": "0.1e0", "dz": "0.1e0", "frames": "8", "samples": but("8", "7", 6)})
contract("P13_package", "package", {"package_id": text(1), "source_ok": "event_id % 41 <> 2", "surface_ok": "event_id % 41 <> 3", "map_ok": "event_id % 41 <> 4", "note": but("'plain'", "'naïve'", 5)})
contract("P14_coordinate_frame", "coordinate_frame", {"dx": but("0.1e0", "-0.01e0", 1), "dy": but("0.1e0", NAN, 2), "dz": "value"})
contract("P15_collider", "collider", {"inflation": but("0.1e0", "-0.1e0", 1), "padding": "0e0", "shell": but("0.1e0", INFINITE, 2)})
contract("P16_rig", "rig", {"vertex_idx": "event_id % 2503", "joint": "event_id % 21", "joints": "21 - (CASE WHEN event_id % 2503 < 30 THEN 3 ELSE 0 END)", "weight": but("0.25e0", "-0.1e0", 5, 501)})
contract("P17_joint_frame", "joint_frame", {"frame": "event_id % 307", "time_seconds": "CASE WHEN event_id % 307 < 5 THEN -1e0 ELSE 1e0 END", "x": but("value", NAN, 7, 911), "y": "0e0", "z": "0e0", "confidence": "CASE WHEN event_id % 307 < 100 THEN NULL WHEN event_id % 307 < 110 AND event_id % 2 = 0 THEN NULL WHEN event_id % 307 < 120 THEN 1.5e0 ELSE 0.5e0 END"}, where="value IS NOT NULL")
contract("P18_validation_frame", "validation_frame", {"frame_id": text(1), "reference_space": text(2), "source": "'tracker'", "time_seconds": but("1e0", "-1e0", 3), "topology_key": "event_id % 5", "surface_key": but("event_id % 5", "7", 4), "normals": but("0", "12", 5), "vertices": "13"})
contract("P19_hand_substrate", "hand_substrate", {"conformance_id": text(1), "provider_id": "'p'", "frame_id": "'f'", "basis": but(f"'{BASES[0]}'", "'left_handed'", 2), "rig_source": but("'p'", "'q'", 3), "frame_source": "'p'", "rig_side": "'left'", "frame_side": but("'left'", "'right'", 4), "joints": "26", "poses": but("26", "25", 5)})
contract("P20_sdf_config", "sdf_config", {"voxel_size": but(but("0.1e0", "0e0", 1), NAN, 2), "max_voxels": but("1000", "0", 3)})
contract("P21_packed_grid", "packed_grid", {"grid_id": "event_id % 1250", "nx": "2", "ny": "2", "nz": "CASE WHEN event_id % 1250 < 40 THEN 0 WHEN event_id % 1250 < 90 THEN 3 ELSE 2 END", "distance": but("value", INFINITE, 8, 997)}, where="event_id < 10000 AND value IS NOT NULL")
contract("P22_adf_config", "adf_config", {"max_depth": but("6", "17", 1), "max_cells": but("4096", "0", 2), "tolerance": but("0.01e0", "-0.01e0", 3)})
contract("P23_adf_cells", "adf_cell", {"ox": but("0e0", NAN, 1), "oy": "0e0", "oz": "0e0", "extent": but("1e0", "0e0", 2), "center_distance": "0e0", "min_distance": "-1e0", "max_distance": but("1e0", "-2e0", 3), "level": but("3", "9", 4), "max_depth": "8", "sample_count": but("4", "0", 5)})
contract("P23_adf_field", "adf_field", {"field_id": "event_id % 103", "extent": "CASE WHEN event_id % 103 < 5 THEN 0e0 ELSE 1e0 END", "max_depth": "CASE WHEN event_id % 103 < 9 THEN 20 ELSE 8 END", "level": "CASE WHEN event_id % 103 < 12 THEN NULL WHEN event_id % 103 < 15 THEN 11 ELSE event_id % 7 END"})
contract("P24_particles", "particle", {"particle_id": text(9), **XYZ, "vx": "0e0", "vy": but("0e0", NAN, 10), "vz": "0e0", "radius": but("0.1e0", "-0.1e0", 11), "inverse_mass": but("1e0", "-1e0", 12), "age": but("0e0", NAN, 13)})
contract("P25_particle_set", "particle_set", {"set_id": "CASE WHEN event_id % 59 = 0 THEN ' ' ELSE CAST(event_id % 59 AS STRING) END", "time_seconds": "CASE WHEN event_id % 59 < 3 THEN -1e0 ELSE 0e0 END", "radius": "CASE WHEN event_id % 59 < 6 AND event_id % 2 = 0 THEN -1e0 ELSE 1e0 END"})
contract("P26_fixed_step", "fixed_step", {"config_id": text(1), "step_seconds": but("0.1e0", "0e0", 2), "max_steps": but("4", "0", 3), "neighbor_radius": but("0.1e0", "-0.1e0", 4), "neighbor_strength": but("0.1e0", NAN, 5)})
contract("P27_influence", "influence", {**XYZ, "strength": but("1e0", NAN, 4), "radius": but("1e0", "-1e0", 5)})
contract("P27_impulse", "impulse", {**XYZ, "dx": "0e0", "dy": but("1e0", INFINITE, 4), "dz": "0e0", "radius": but("1e0", "-1e0", 5)})
contract("P27_body", "body", {**BOX, "shape": pick("sphere", "box", "cone"), "radius": but("1e0", "-1e0", 6), "restitution": but("0.5e0", "-0.5e0", 7)})
contract("P28_render_payload", "render_payload", {"payload_id": "event_id % 211", "time_seconds": "CASE WHEN event_id % 211 < 4 THEN CAST('NaN' AS DOUBLE) ELSE 1e0 END", "sample_idx": "CASE WHEN event_id % 211 < 30 THEN NULL ELSE event_id END", "min_x": "CASE WHEN event_id % 211 < 20 OR event_id % 211 BETWEEN 40 AND 50 THEN NULL ELSE 0e0 END", "min_y": "0e0", "min_z": "0e0", "max_x": "CASE WHEN event_id % 211 > 200 THEN -1e0 ELSE 1e0 END", "max_y": "1e0", "max_z": "1e0"})
contract("P29_field_nodes", "field_node", {"node_id": text(9), "node_idx": but("event_id", "event_id + 1", 10), "expected_idx": "event_id", **XYZ, **_BARY})
contract("P30_field_buffers", "field_buffers", {"field_id": "event_id % 200", "node_idx": "CASE WHEN event_id % 200 < 10 THEN 0 ELSE event_id - event_id % 200 END", "nodes": "50", "value": but("value", NAN, 7, 1999)}, where="event_id < 10000 AND value IS NOT NULL")
contract("P31_perturbation", "perturbation", {"perturbation_id": "event_id % 307", "node_idx": "(event_id * 11) % 1009", "nodes": "CASE WHEN event_id % 307 < 60 THEN 1000 ELSE 1009 END", "duration": "CASE WHEN event_id % 307 > 300 THEN 0 ELSE 3 END", "amount": but("1e0", NAN, 5, 1511)})
contract("P32_field_runtime", "field_runtime", {"config_id": text(1), "step_seconds": but("0.1e0", "0e0", 2), "max_steps": but("8", "0", 3), "neighbor_tiers": but("2", "3", 4), "clamp_low": "-1e0", "clamp_high": but("1e0", "-1e0", 5), "vector_length": but("1e0", "0e0", 6), "diffusion": but("1e0", "-1e0", 7), "decay": but("1e0", NAN, 8), "alignment": "1e0", "gradient": "1e0", "second_tier": but("0.35e0", "1.5e0", 9)})
contract("P33_dynamics_plan", "dynamics_plan", {"plan_id": "event_id % 101", "from_node": "event_id % 33", "to_node": but("event_id % 33 + 1", "event_id % 33", 6, 1201), "nodes": "CASE WHEN event_id % 101 < 20 THEN 33 ELSE 34 END", "tier": "event_id % 2 + 1", "enabled": "CASE WHEN event_id % 101 < 25 THEN 1 ELSE 2 END", "weight": but("1e0", "0e0", 3, 1301), "links": "CASE WHEN event_id % 101 < 30 THEN 7 ELSE 99 END"}, where="event_id < 9999")
contract("P34_circuit_state", "circuit_state", {"circuit_id": "event_id % 211", "edge_id": "CASE WHEN event_id % 211 < 5 THEN NULL WHEN event_id % 211 < 20 THEN event_id % 422 ELSE event_id END", "time_seconds": "CASE WHEN event_id % 211 < 8 THEN -1e0 ELSE 0e0 END", "from_node": "CASE WHEN event_id % 211 < 30 THEN 1 ELSE event_id % 89 END", "to_node": "CASE WHEN event_id % 211 < 30 THEN 2 WHEN event_id % 1511 = 40 THEN event_id % 89 ELSE event_id % 89 + 1 END", "tier": "event_id % 2", "nodes": "CASE WHEN event_id % 211 < 60 THEN 80 ELSE 90 END"})
contract("P35_circuit_config", "circuit_config", {"config_id": text(1), "step_seconds": but("0.1e0", "-1e0", 2), "max_steps": but("8", "0", 3), "v_low": "-1e0", "v_high": but("1e0", "-1e0", 4), "g_low": but("0e0", "-1e0", 5), "g_high": but("4e0", INFINITE, 6), "current": but("8e0", "0e0", 7)})
contract("P36_circuit_edit", "circuit_edit", {"edit_id": text(1), "operation": pick("set_voltage", "scale_conductance", "set_gate_bounds", "set_gate_threshold", "transient_current"), "amount": but(but("0.5e0", NAN, 2), "-0.5e0", 3), "amount2": but("1e0", "0.1e0", 4), "slope": but("NULL", "0e0", 5), "duration": but("3", "0", 6), "target": "event_id % 70", "targets": "64"})
contract("P36_edit_result", "edit_result", {"result_id": text(1), "edit_id": "'e'", "accepted": "event_id % 3 = 0", "reason": but("CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'revision mismatch' END", "' '", 2), "revision_before": "event_id", "revision_after": but("CASE WHEN event_id % 3 = 0 THEN event_id + 1 ELSE event_id END", "event_id", 3)})
contract("P37_debug_sequence", "debug_sequence", {"sequence_id": "event_id % 97", "step_seconds": "CASE WHEN event_id % 97 < 3 THEN 0e0 ELSE 1e0 END", "stride": "CASE WHEN event_id % 97 < 6 THEN 0 ELSE 1 END", "step": "CASE WHEN event_id % 97 < 10 THEN 5 WHEN event_id % 97 < 12 THEN event_id + 1 ELSE event_id - event_id % 97 END", "steps": "CASE WHEN event_id % 97 < 20 THEN 7 ELSE 9894 - 97 * (CASE WHEN event_id % 97 > 8 THEN 1 ELSE 0 END) END"}, where="event_id < 9900")
contract("P38_run_summary", "run_summary", {"summary_id": text(1), "nodes": but("9", "0", 2), "scalar_fields": "event_id % 2", "vector_fields": but("1", "0", 4, 10), "low": but("0e0", "NULL", 5), "high": but(but("1e0", "NULL", 5), "-1e0", 6), "longest": but(but("NULL", "1e0", 7), "-1e0", 8)})
contract("P38_step_diagnostics", "step_diagnostics", {"active_terms": "event_id % 9", "terms": "7", "active_gates": "event_id % 5", "edges": "4", "clamped": but("3", "11", 4), "nodes": "10", "largest": but("0.1e0", NAN, 5)})
contract("P39_axis_map", "axis_map", {"map_id": "event_id % 89", "nodes": "CASE WHEN event_id % 89 < 8 THEN 3 ELSE 100 END", "nz": "(event_id % 21 - 10) * 1e-1", "region": "CASE WHEN event_id % 89 < 20 AND event_id % 21 = 2 THEN 3 WHEN event_id % 21 < 4 THEN 1 WHEN event_id % 21 < 9 THEN 2 WHEN event_id % 21 < 13 THEN 3 WHEN event_id % 21 < 17 THEN 4 ELSE 5 END"}, where="event_id < 8900")
contract("P40_scenario_run", "scenario_run", {"run_id": text(1), "evidence_type": "'synthetic'", "expected_outcome": text(2), "surface_id": "'s'", "substrate_surface": but("'s'", "'t'", 3), "surface_key": "1", "substrate_key": but("1", "2", 4), "circuit_substrate": but("'b'", "'c'", 5), "substrate_id": "'b'", "sequence_substrate": "'b'", "sequence_circuit": but("'k'", "'l'", 6), "circuit_id": "'k'", "sequence_dt": but("0.1e0", "0.2e0", 7), "circuit_dt": "0.1e0", "anchor": text(8)})
contract("P41_trace_set", "trace_set", {"set_id": "event_id - event_id % 5", "scenario": "CASE WHEN event_id % 35 = 4 THEN 0 ELSE event_id % 5 END", "substrate_id": but("'b'", "'c'", 3, 101), "surface_id": "'s'", "stride": but("15", "0", 2, 211), "dt": but("0.1e0", "0e0", 1, 307)}, where="event_id < 5000")
contract("P41_morphology", "morphology", {"metrics_id": "event_id - event_id % 5", "anchor": "CASE WHEN (event_id - event_id % 5) % 55 = 0 THEN NULL ELSE 'target' END", "region": "CASE WHEN event_id % 65 = 4 THEN 0 ELSE event_id % 5 END", "fraction": but("0.2e0", "0.3e0", 3, 101), "ap_min": "0e0", "ap_max": but("1e0", "1.5e0", 2, 97)}, where="event_id < 5000")
contract("P42_dynamics_target", "dynamics_target", {"target_id": text(1, "'gap'"), "anchor": but("'paper target:gap'", "'paper'", 2), "blocked_use": but("'no calibrated physiology'", "'none'", 3), "source_id": pick("planformdb_250", "other"), "record_id": but("'planformdb:experiment:9'", "'9'", 4)})
contract("P42_dynamics_targets", "dynamics_targets", {"fixture_id": "event_id - event_id % 4", "target_id": f"CASE WHEN event_id % 44 = 3 THEN '{REQUIRED_TARGETS[0]}' WHEN event_id % 52 = 1 THEN 'other' ELSE {pick(*REQUIRED_TARGETS, 'more')} END", "policy": "CASE WHEN (event_id - event_id % 4) % 28 = 0 THEN 'calibrated' ELSE 'these are not calibrated' END"}, where="event_id < 4000")
_HASH = f"'{'0a' * 32}'"
contract("P43_bridge", "bridge", {"fixture_id": text(1), "bridge_id": "'b'", "doi": text(2), "run_id": "'r'", "manifest_sha256": but(_HASH, "'12'", 3), "map_sha256": _HASH, "path": pick(*[f"{r}x.json" for r in PUBLIC_ROOTS], "/data/bridges/../x", "/data/replays/raw/x", "data/x"), "elements": but("9", "0", 4), "mapped": but("9", "8", 5), "replay_nodes": "9", "replay_edges": but("9", "0", 6), "replay_frames": "9"})
contract("P43_bridge_inputs", "bridge_inputs", {"fixture_id": "event_id - event_id % 5", "kind": f"CASE WHEN event_id % 45 = 4 THEN '{REQUIRED_INPUTS[0]}' WHEN event_id % 65 = 3 THEN 'other' ELSE {pick(*REQUIRED_INPUTS)} END"}, where="event_id < 5000")
contract("P43_P46_policy_texts", "bridge_policy", {"policy": pick("not runtime dynamics", " ", "see C:x", "the RAW/ folder", "a decoder of it", "key material here", "plain words")})
contract("P44_substrate_request", "substrate_request", {"request_id": text(1), "bridge_id": "'b'", "elements": but("9", "0", 2), "nodes": but("9", "8", 3), "status": but("'request_only_not_materialized'", "'materialized'", 4), "neighbors": "event_id % 15", "weights": but("'not conductance and not voltage'", "'conductance'", 5)})
contract("P44_blocked_outputs", "substrate_outputs", {"request_id": "event_id - event_id % 7", "output": pick("display_substrate_graph_fixture", "source_map_node_index", *BLOCKED_OUTPUTS, by="event_id"), "allowed": "event_id % 7 < 2 OR event_id % 91 = 30 OR event_id % 77 = 5"}, where="event_id < 4998")
contract("P45_P46_asset_paths", "public_path", {"path": pick(*[f"{r}{n}" for r in PUBLIC_ROOTS for n in ("x.json", "../x", "a/raw/x", "b:x", "x.LOG")], "", "relative/x")})
contract("P47_hashes", "hash", {"hash": pick("0a" * 32, "0A" * 32, "0g" * 32, "0a" * 31, "")})
contract("P48_derived_records", "derived_record", {"record_id": but("concat('planformdb:experiment:', CAST(event_id - event_id % 3 AS STRING), ':resultset:', CAST((event_id - event_id % 3) % 7 AS STRING))", "'x'", 1, 301), "experiment": "event_id - event_id % 3", "resultset": "(event_id - event_id % 3) % 7", "frequency": but("CASE WHEN event_id % 3 = 0 THEN 0.5e0 ELSE 0.25e0 END", "1.2e0", 2, 201)})
contract("P48_derived_fixture", "derived_fixture", {"fixture_id": "event_id - event_id % 6", "citation": "CASE WHEN event_id % 66 < 6 THEN 'only' WHEN event_id % 2 = 0 THEN 'lobo_2013_planform' ELSE 'second' END", "record_id": but("event_id", "event_id + 1", 2, 202)}, where="event_id < 6000")
contract("P49_head_taxonomy", "head_taxonomy", {"taxonomy_id": "event_id - event_id % 4", "label_id": "CASE WHEN event_id % 44 = 3 THEN 'a' WHEN event_id % 4 = 0 AND event_id % 52 <> 0 THEN 'unclassified_teaching_abstraction' WHEN event_id % 4 = 1 THEN 'a' WHEN event_id % 4 = 2 THEN 'b' ELSE 'c' END", "policy": "CASE WHEN event_id % 400 < 4 THEN 'any' ELSE 'no paper figure reuse' END"}, where="event_id < 4000")
contract("P52_surface_runtime", "surface_runtime", {"runtime_id": text(1), "set_id": text(2), "inflation": but("0e0", "-1e0", 3), "padding": "0e0", "shell": "0e0", "voxel_size": but("0.1e0", "0e0", 4), "max_depth": but("6", "17", 5)})
contract("P52_particle_reset", "particle_reset", {"particles": "event_id * 10", "cloud_radius": but("1e0", "-1e0", 1), "particle_radius": but("1e0", NAN, 2), "surface_radius": "1e0"})
contract("T19_frame_times", "frame_input", {"time_seconds": but(but("value", "-1e0", 1), INFINITE, 2)})
