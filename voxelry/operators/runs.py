"""Whole runs of many circuits side by side.

One circuit's steps depend on one another, but circuits don't: each is one group, whose
nodes, edges and terms become arrays, and only the frames that are asked for leave it.  A
group is a single circuit and bounded by ``MOST_ROWS``; a larger one is stepped by
``circuit.step``, which is joins and aggregates for each step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .circuit import Config, Gate, Memory

#: Nodes, edges and terms of one circuit.
MOST_ROWS = 5_000_000
FRAMES = "circuit_id bigint, step bigint, node_idx bigint, voltage double, memory double, head double, tail double"


class Layers:
    """two readouts of the voltage and memory, each with weights, bias, rate and limits."""

    def __init__(self, head=(1.5, 0.7), tail=(-1.5, -0.5), bias: float = 0.5, rate: float = 2.0):
        self.weights, self.bias, self.rate = (head, tail), bias, rate


def _run(nodes: dict, rows: dict, steps: int, stride: int, gate: Gate | None, memory: Memory | None, layers: Layers, c: Config):
    order = np.argsort(nodes["node_idx"])
    ids = np.asarray(nodes["node_idx"])[order]
    v = np.asarray(nodes["voltage"], float)[order]
    m = np.array([np.nan if x is None else x for x in nodes["memory"]], float)[order]
    has = not bool(np.isnan(m).all()) and memory is not None
    r = [np.clip(layers.bias + w[0] * v, 0, 1) for w in layers.weights]
    at = lambda x: np.searchsorted(ids, np.asarray(x, np.int64))
    kinds = np.array(rows["kind"], object)
    pick = lambda name, mask: np.array([np.nan if x is None else x for x, ok in zip(rows[name], mask, strict=True) if ok], float)
    edge = kinds == "edge"
    a, b, base = at(pick("a", edge)), at(pick("b", edge)), pick("p1", edge)
    terms = [(k, *(rows[p][i] for p in ("p1", "p2", "p3", "p4")), rows["a"][i], rows["start_step"][i], rows["duration"][i]) for i, k in enumerate(rows["kind"]) if k != "edge"]
    limit = lambda x: np.clip(x, -c.current, c.current)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def frame(k):
        return k, ids, v.copy(), m.copy() if has else np.full(len(v), np.nan), *(x.copy() for x in r)

    yield frame(0)
    for step in range(steps):
        g = base
        if gate is not None:
            source = {"difference": np.abs(v[b] - v[a]), "source": v[a], "target": v[b], "memory": np.nan_to_num(m[a])}[gate.source]
            g = base * (gate.least + (gate.most - gate.least) * sigmoid((source - gate.threshold) / gate.slope))
        flow = np.zeros(len(v))
        np.add.at(flow, a, limit(np.clip(g, c.g_low, c.g_high) * (v[b] - v[a])))
        for kind, p1, p2, p3, p4, node, start, duration in terms:
            if start <= step and (duration is None or step < start + duration):
                own = slice(None) if node is None else at([node])
                x = v[own]
                i = p1 if kind == "constant" else p1 * (p2 - x) if kind in ("leak", "pump") else p1 * sigmoid((x - p3) / (p4 or 1.0)) * (p2 - x)
                flow[own] += limit(i)
        v = np.clip(v + c.dt * flow, c.v_low, c.v_high)
        if has:
            m = np.clip(np.where(v >= memory.activation, m + c.dt * memory.rise * (1 - m), np.where(v <= memory.release, m - c.dt * memory.decay * m, m)), 0, 1)
        held = m if has else np.zeros(len(v))
        r = [np.clip(x + c.dt * layers.rate * (layers.bias + w[0] * v + w[1] * held - x), 0, 1) for x, w in zip(r, layers.weights, strict=True)]
        if (step + 1) % stride == 0 or step + 1 == steps:
            yield frame(step + 1)


def run(nodes: DataFrame, edges: DataFrame, terms: DataFrame, steps: int, stride: int = 1, gate: Gate | None = None, memory: Memory | None = None, layers: Layers | None = None, config: Config | None = None) -> DataFrame:
    """Frames of every circuit at step 0, every ``stride``-th step and the last.

    nodes(circuit_id, node_idx, voltage, memory (null: none)), edges(circuit_id, from_node,
    to_node, base), terms(circuit_id, kind, p1 .. p4, node_idx (null: all), start_step, duration).
    """
    layers, config = layers or Layers(), config or Config(dt=1 / 30)
    none = F.lit(None)
    e = edges.select("circuit_id", F.lit("edge").alias("kind"), F.col("from_node").cast("bigint").alias("a"), F.col("to_node").cast("bigint").alias("b"), F.col("base").cast("double").alias("p1"), *[none.cast("double").alias(f"p{k}") for k in (2, 3, 4)], none.cast("int").alias("start_step"), none.cast("int").alias("duration"))
    t = terms.select("circuit_id", "kind", F.col("node_idx").cast("bigint").alias("a"), none.cast("bigint").alias("b"), *[F.col(f"p{k}").cast("double").alias(f"p{k}") for k in (1, 2, 3, 4)], F.col("start_step").cast("int"), F.col("duration").cast("int"))
    right = e.unionByName(t)

    def both(key: tuple, left: pa.Table, more: pa.Table) -> pa.Table:
        if left.num_rows + more.num_rows > MOST_ROWS:
            raise ValueError(f"circuit {key[0]} has more than {MOST_ROWS} rows: use circuit.step")
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        if left.num_rows:
            for k, ids, v, m, head, tail in _run(left.to_pydict(), more.to_pydict(), steps, stride, gate, memory, layers, config):
                for out, x in zip(cols, (np.full(len(ids), key[0].as_py()), np.full(len(ids), k), ids, v, m, head, tail), strict=True):
                    out.append(x)
        names = [x.split(" ")[0] for x in FRAMES.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 4
        whole = [np.concatenate(x) if x else np.zeros(0) for x in cols]
        return pa.table([pa.array(x.astype(np.int64) if k == pa.int64() else x, k, from_pandas=True) for x, k in zip(whole, kinds, strict=True)], names)

    return nodes.select("circuit_id", "node_idx", "voltage", "memory").groupBy("circuit_id").cogroup(right.groupBy("circuit_id")).applyInArrow(both, FRAMES)
