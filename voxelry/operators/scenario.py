"""Axis maps of a body, scenarios of its circuit, and what is measured of their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp

# Regions from tail to head, their bands on normalised z, and target voltages.
REGIONS = ("tail", "postpharyngeal", "pharyngeal", "prepharyngeal", "head")
THRESHOLDS = (-0.62, -0.18, 0.24, 0.66)
TARGETS = (-0.28, -0.14, 0.0, 0.14, 0.28)
SCENARIOS = ("baseline", "transverse_cut_wound", "gap_block", "transient_memory", "transient_no_memory_control")


def region_code(z: Column) -> Column:
    """1 to 5; a threshold belongs to the band above it."""
    out = F.lit(len(THRESHOLDS) + 1)
    for k, t in reversed(list(enumerate(THRESHOLDS))):
        out = F.when(z < t, k + 1).otherwise(out)
    return out


def target_voltage(code: Column) -> Column:
    """F46."""
    return F.element_at(F.array(*[F.lit(v) for v in TARGETS]), code)


def region_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in REGIONS]), code)


def axis_frame(nodes: DataFrame) -> DataFrame:
    """The span along z and the greatest half width; no row for a degenerate span."""
    return nodes.agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.max(F.abs("x")).alias("half_width")).filter(F.col("z_max") - F.col("z_min") > 1e-6)


def axis_map(nodes: DataFrame) -> DataFrame:
    """position along the axis (0..1 and -1..1), lateral position, and region."""
    frame = F.broadcast(axis_frame(nodes))  # one row
    ap = clamp((F.col("z") - F.col("z_min")) / (F.col("z_max") - F.col("z_min")), 0, 1)
    lateral = clamp(F.when(F.col("half_width") > 1e-9, F.col("x") / F.col("half_width")).otherwise(0.0), -1.5, 1.5)
    out = nodes.crossJoin(frame).select("node_idx", "x", "y", "z", ap.alias("ap"), (2 * ap - 1).alias("nz"), lateral.alias("lateral"))
    return out.withColumn("region", region_code(F.col("nz")))


def region_extents(mapped: DataFrame) -> DataFrame:
    """A26."""
    total = F.broadcast(mapped.agg(F.count("*").alias("total")))  # one row
    rows = mapped.groupBy("region").agg(F.count("*").alias("n"), F.min("ap").alias("ap_min"), F.max("ap").alias("ap_max"), F.avg(F.abs("lateral")).alias("mean_lateral"))
    return rows.crossJoin(total).select("region", "n", (F.col("n") / F.col("total")).alias("fraction"), "ap_min", "ap_max", (F.col("ap_max") - F.col("ap_min")).alias("span"), "mean_lateral")


def in_band(mapped: DataFrame, low: float, high: float) -> DataFrame:
    """nodes in a band of normalised z, both ends included."""
    return mapped.filter(F.col("nz").between(low, high))


def crosses_cut(z_from: Column, z_to: Column, cut: float) -> Column:
    """The ends lie on different sides of the cut."""
    return ((z_from < cut) & (z_to >= cut)) | ((z_to < cut) & (z_from >= cut))


def cut_conductance(edges: DataFrame, mapped: DataFrame, cut: float) -> DataFrame:
    """Mean base conductance of the edges across the cut; no row without any."""
    a, b = (mapped.select(F.col("node_idx").alias(k), F.col("nz").alias(f"z_{k}")) for k in ("from_node", "to_node"))
    both = edges.join(a, "from_node").join(b, "to_node").filter(crosses_cut(F.col("z_from_node"), F.col("z_to_node"), cut))
    return both.agg(F.avg("base").alias("average"), F.count("*").alias("edges")).filter("edges > 0")


# Fixed values of the scenarios' circuits.
CUT, CUT_HALF_WIDTH = 0.16, 0.11
LEAK, PUMP = 0.05, 1.15
WOUND, WOUND_STEPS = 1.65, 36
TRANSIENT, TRANSIENT_START, TRANSIENT_STEPS = 2.75, 2, 30
TIER_1, TIER_2, GAP_BLOCK = 0.12, 0.03, 0.08
HEAD_WEIGHT, READOUT_BIAS = 1.5, 0.5
GATE = ("difference", 0.12, 0.035, 0.35, 1.45)
MEMORY = (0.25, -0.95, 4.0, 0.04)


def initial_state(mapped: DataFrame, scenario: str) -> DataFrame:
    """Voltages of the regions' targets, both readouts, and memory unless the
    scenario is the control without it."""
    v = target_voltage(F.col("region"))
    memory = F.lit(None).cast("double") if scenario == "transient_no_memory_control" else F.lit(0.0)
    readout = lambda sign: clamp(READOUT_BIAS + sign * HEAD_WEIGHT * v, 0, 1)
    return mapped.select("node_idx", v.alias("voltage"), memory.alias("memory"), readout(1).alias("readout"), readout(-1).alias("tail"))


def scenario_terms(mapped: DataFrame, scenario: str, cut_low: float = CUT - CUT_HALF_WIDTH, cut_high: float = CUT + CUT_HALF_WIDTH) -> DataFrame:
    """A leak, each node's pump, and the wound or the transient of a scenario."""
    none = F.lit(None)

    def rows(nodes: DataFrame, kind: str, p1: Column, p2: Column, start: int = 0, duration: int | None = None) -> DataFrame:
        return nodes.select(F.lit(kind).alias("kind"), p1.cast("double").alias("p1"), p2.cast("double").alias("p2"), none.cast("double").alias("p3"), none.cast("double").alias("p4"), F.col("node_idx").cast("bigint"), F.lit(start).alias("start_step"), F.lit(duration).cast("int").alias("duration"))

    leak = rows(mapped.sparkSession.range(1).select(none.cast("bigint").alias("node_idx")), "leak", F.lit(LEAK), F.lit(0.0))
    out = leak.union(rows(mapped, "pump", F.lit(PUMP), target_voltage(F.col("region"))))
    if scenario == "transverse_cut_wound":
        out = out.union(rows(in_band(mapped, cut_low, cut_high), "constant", F.lit(WOUND), F.lit(0.0), 0, WOUND_STEPS))
    if scenario.startswith("transient"):
        out = out.union(rows(mapped.filter("region in (1, 2)"), "constant", F.lit(TRANSIENT), F.lit(0.0), TRANSIENT_START, TRANSIENT_STEPS))
    return out


def scenario_edges(edges: DataFrame, mapped: DataFrame, scenario: str, cut: float = CUT) -> DataFrame:
    """Conductances by tier; under the gap block those across the cut are nearly closed."""
    a, b = (mapped.select(F.col("node_idx").alias(k), F.col("nz").alias(f"z_{k}")) for k in ("from_node", "to_node"))
    g = F.when(F.col("tier") == 1, TIER_1).otherwise(TIER_2)
    if scenario == "gap_block":
        g = g * F.when(crosses_cut(F.col("z_from_node"), F.col("z_to_node"), cut), GAP_BLOCK).otherwise(1.0)
    key = F.xxhash64("from_node", "tier", "to_node")
    return edges.join(a, "from_node").join(b, "to_node").select(key.alias("edge_idx"), "from_node", "to_node", "tier", g.alias("base"), g.alias("conductance"))


def outcome_samples(frames: DataFrame, mapped: DataFrame, *keys: str) -> DataFrame:
    """Of each frame the means that are compared between scenarios, 0 where none.

    frames(keys, step, node_idx, voltage, memory, head, tail): memory and head readout of the
    posterior, each readout at its own end, and the voltage about the cut.
    """
    both = frames.join(mapped.select("node_idx", "region", "nz"), "node_idx")
    mean = lambda k, where: F.coalesce(F.avg(F.when(where, F.col(k))), F.lit(0.0))
    region = F.col("region")
    posterior, band = region.isin(1, 2), F.col("nz").between(CUT - CUT_HALF_WIDTH, CUT + CUT_HALF_WIDTH)
    return both.groupBy(*keys, "step").agg(mean("memory", posterior).alias("posterior_memory"), mean("head", posterior).alias("posterior_head"), mean("head", region == 5).alias("head_at_head"), mean("tail", region == 1).alias("tail_at_tail"), mean("voltage", band).alias("cut_voltage"))


def trace_set(frames: DataFrame, mapped: DataFrame, edges: DataFrame) -> DataFrame:
    """The samples of every scenario, with the mean conductance across its cut.

    frames(scenario, step, ...), edges(scenario, from_node, to_node, base)
    """
    a, b = (mapped.select(F.col("node_idx").alias(k), F.col("nz").alias(f"z_{k}")) for k in ("from_node", "to_node"))
    across = edges.join(a, "from_node").join(b, "to_node").filter(crosses_cut(F.col("z_from_node"), F.col("z_to_node"), CUT))
    return outcome_samples(frames, mapped, "scenario").join(across.groupBy("scenario").agg(F.avg("base").alias("cut_conductance")), "scenario")


def head_extent(frames: DataFrame) -> DataFrame:
    """The share of nodes whose last readout is at least one half."""
    last = F.broadcast(frames.agg(F.max("step").alias("step")))  # one row
    return frames.join(last, "step").agg(F.avg((F.col("readout") >= 0.5).cast("double")).alias("head_extent"))


def emitted(frames: DataFrame, stride: int) -> DataFrame:
    """The first step, every stride-th and the last."""
    last = F.broadcast(frames.agg(F.max("step").alias("last_step")))  # one row
    return frames.crossJoin(last).filter((F.col("step") % stride == 0) | (F.col("step") == F.col("last_step"))).drop("last_step")


def node_activity(frames: DataFrame) -> DataFrame:
    """The greatest change of each node's voltage, against the greatest of all."""
    from pyspark.sql import Window

    before = F.lag("voltage").over(Window.partitionBy("node_idx").orderBy("step"))
    most = frames.withColumn("change", F.abs(F.col("voltage") - before)).groupBy("node_idx").agg(F.coalesce(F.max("change"), F.lit(0.0)).alias("most"))
    top = F.broadcast(most.agg(F.max("most").alias("top")))  # one row
    return most.crossJoin(top).select("node_idx", F.when(F.col("top") > 1e-6, F.col("most") / F.col("top")).otherwise(0.0).alias("activity"))
