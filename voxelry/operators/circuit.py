"""Bioelectric circuits: currents, gated conductances, memory and readouts.

state(node_idx, voltage, memory, readout), edges(edge_idx, from_node, to_node, tier, base,
conductance), terms(term_idx, kind, p1, p2, p3, p4, node_idx or null for all, start_step,
duration or null for ever).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp


@dataclass(frozen=True)
class Config:
    dt: float = 1 / 60
    v_low: float = -1.0
    v_high: float = 1.0
    g_low: float = 0.0
    g_high: float = 4.0
    current: float = 8.0


@dataclass(frozen=True)
class Gate:
    """a sigmoid of its source between a least and a greatest factor."""

    source: str = "difference"  # difference, source, target, memory
    threshold: float = 0.07
    slope: float = 0.018
    least: float = 0.3
    most: float = 1.65

    def factor(self, v_from: Column, v_to: Column, memory: Column) -> Column:
        s = {"difference": F.abs(v_to - v_from), "source": v_from, "target": v_to, "memory": memory}[self.source]
        return self.least + (self.most - self.least) / (1 + F.exp(-clamp((s - self.threshold) / self.slope, -50, 50)))


@dataclass(frozen=True)
class Memory:
    activation: float = 0.24
    release: float = -0.16
    rise: float = 1.9
    decay: float = 0.55


@dataclass(frozen=True)
class Readout:
    voltage: float = 0.8
    memory: float = 0.45
    bias: float = 0.08
    rate: float = 1.25
    low: float = -1.0
    high: float = 1.0


def conductances(edges: DataFrame, tier1: float = 0.16, tier2: float = 0.045) -> DataFrame:
    """Edges between neighbours with the conductance of their tier; numbered in order."""
    g = F.when(F.col("tier") == 1, tier1).otherwise(tier2)
    key = F.struct("from_node", "tier", "to_node")
    return edges.select(F.xxhash64(key).alias("edge_idx"), "from_node", "to_node", "tier", g.alias("base"), g.alias("conductance"))


def term_current(v: Column, term: Column | None = None) -> Column:
    """leak and pump pull to a voltage, constant pushes, gated opens above a threshold."""
    of = F.col if term is None else term.__getitem__
    k, p = of("kind"), [of(f"p{i}") for i in (1, 2, 3, 4)]
    gated = p[0] / (1 + F.exp(-clamp((v - p[2]) / F.coalesce(p[3], F.lit(1.0)), -50, 50))) * (p[1] - v)
    return F.when(k == "leak", p[0] * (p[1] - v)).when(k == "constant", p[0]).when(k == "pump", p[0] * (p[1] - v)).when(k == "gated", gated)


def gated_edges(state: DataFrame, edges: DataFrame, gate: Gate | None, c: Config) -> DataFrame:
    """Edges with the voltages at their ends and the conductance of this step."""
    a = state.select(F.col("node_idx").alias("from_node"), F.col("voltage").alias("v_from"), F.col("memory").alias("m_from"))
    b = state.select(F.col("node_idx").alias("to_node"), F.col("voltage").alias("v_to"))
    both = edges.join(a, "from_node").join(b, "to_node")
    g = F.col("base") * (gate.factor(F.col("v_from"), F.col("v_to"), F.coalesce("m_from", F.lit(0.0))) if gate else F.lit(1.0))
    return both.withColumn("conductance", clamp(g, c.g_low, c.g_high)).withColumn("g_clamped", (clamp(g, c.g_low, c.g_high) != g).cast("int"))


def step(state: DataFrame, edges: DataFrame, terms: DataFrame, index: int, gate: Gate | None = None, memory: Memory | None = Memory(), readout: Readout = Readout(), c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Currents by the previous voltages, each clamped before it is added; then
    voltage, memory and readout.  Returns the state (with current, delta) and the edges."""
    now = gated_edges(state, edges, gate, c)
    limit = lambda i: clamp(i, -c.current, c.current)
    flow = now.groupBy(F.col("from_node").alias("node_idx")).agg(F.sum(limit(F.col("conductance") * (F.col("v_to") - F.col("v_from")))).alias("flow"))
    due = terms.filter((F.col("start_step") <= index) & (F.col("duration").isNull() | (F.lit(index) < F.col("start_step") + F.col("duration")))).drop("start_step", "duration")
    v = F.col("voltage")
    named = state.select("node_idx", "voltage").join(due.filter("node_idx is not null"), "node_idx").groupBy("node_idx").agg(F.sum(limit(term_current(v))).alias("applied"))
    # The terms of all nodes: one row that holds them all.
    common = due.filter("node_idx is null").agg(F.collect_list(F.struct("kind", "p1", "p2", "p3", "p4")).alias("common"))
    everywhere = F.aggregate("common", F.lit(0.0), lambda a, t: a + F.coalesce(limit(term_current(v, t)), F.lit(0.0)))
    applied = state.select("node_idx", "voltage").crossJoin(F.broadcast(common)).join(named, "node_idx", "left").select("node_idx", (F.coalesce("applied", F.lit(0.0)) + everywhere).alias("applied"))
    all_ = state.join(flow, "node_idx", "left").join(applied, "node_idx", "left")
    current = F.coalesce("flow", F.lit(0.0)) + F.coalesce("applied", F.lit(0.0))
    raw = v + c.dt * current
    new = clamp(raw, c.v_low, c.v_high)
    out = all_.select("node_idx", new.alias("voltage"), F.col("memory"), F.col("readout"), current.alias("current"), F.abs(new - v).alias("delta"), (new != raw).cast("int").alias("v_clamped"))
    if memory is not None:
        m = F.coalesce("memory", F.lit(0.0))
        up, down = m + c.dt * memory.rise * (1 - m), m - c.dt * memory.decay * m
        out = out.withColumn("memory", clamp(F.when(F.col("voltage") >= memory.activation, up).when(F.col("voltage") <= memory.release, down).otherwise(m), 0, 1))
    r = F.col("readout")
    wanted = readout.bias + readout.voltage * F.col("voltage") + readout.memory * F.coalesce("memory", F.lit(0.0))
    out = out.withColumn("readout", clamp(r + c.dt * readout.rate * (wanted - r), readout.low, readout.high))
    return out, now.select("edge_idx", "from_node", "to_node", "tier", "base", "conductance")


def diagnostics(stepped: DataFrame, edges: DataFrame) -> DataFrame:
    """What a step did: nodes, edges, the greatest change and the sum of currents."""
    one = stepped.agg(F.count("*").alias("updated_nodes"), F.sum("v_clamped").cast("long").alias("clamped_nodes"), F.max("delta").alias("max_voltage_delta"), F.sum(F.abs("current")).alias("net_current_abs_sum"))
    return one.crossJoin(edges.agg(F.count("*").alias("visited_edges")))  # one row each


def voltage_neighborhood(edges: DataFrame, node: int, most_tier: int = 2, falloff: float = 0.5) -> DataFrame:
    """Neighbours by edges of either direction: least tier, then greatest weight; the node itself weighs one."""
    near = edges.filter(F.col("tier") <= most_tier)
    both = near.filter(F.col("from_node") == node).select(F.col("to_node").alias("node_idx"), "tier").union(near.filter(F.col("to_node") == node).select(F.col("from_node").alias("node_idx"), "tier"))
    least = both.filter(F.col("node_idx") != node).groupBy("node_idx").agg(F.min("tier").alias("tier"))
    own = edges.sparkSession.createDataFrame([(node, 0)], "node_idx long, tier int")
    return least.withColumn("tier", F.col("tier").cast("int")).union(own).select("node_idx", "tier", F.pow(F.lit(float(falloff)), F.col("tier")).alias("weight"))


def latest_events(events: DataFrame, keep: int = 12, key: str = "circuit_id") -> DataFrame:
    """The last events of each circuit."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("event_idx")))
    return events.withColumn("recency", order).filter(F.col("recency") <= keep)
