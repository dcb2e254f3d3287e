"""Edits of circuits: judged in order, then applied to voltages, memory, conductances, gates and terms.

edits(circuit_id, event_idx, expected_revision or null for any, operation, target (node or
edge), amount, amount2, slope, max_tier, falloff, term_id, start_step, duration),
nodes(circuit_id, node_idx, voltage, memory), edges(circuit_id, edge_idx, from_node, to_node,
tier, base, conductance, threshold, slope, low, high; a null threshold: no gate),
circuits(circuit_id, revision, nodes, edges, has_memory), terms(circuit_id, term_id, ...).

Whether an edit is accepted depends on all edits of its circuit before it, and a voltage on
all of its node's: both are folds over rows in order.  The rows are sorted within partitions
and folded as they stream by, so a fold holds one circuit's (or node's) state and no list,
however many edits there are.  Everything else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp, finite

OPERATIONS = ("set_voltage", "add_voltage", "add_neighborhood", "set_memory", "scale_conductance", "set_gate_threshold", "set_gate_bounds", "transient_current")
GATES = ("set_gate_threshold", "set_gate_bounds")
RESULT = "circuit_id bigint, event_idx bigint, accepted boolean, reason string, revision_before bigint, revision_after bigint"


def checked(edits: DataFrame, circuits: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``invalid`` (the rule that an edit breaks by itself) and ``unavailable``."""
    op, amount = F.col("operation"), F.col("amount")
    on_edge = op.isin(*GATES)
    targets = F.when(on_edge, F.col("n_edges")).otherwise(F.col("n_nodes"))
    gated = edges.filter(F.col("threshold").isNotNull()).select("circuit_id", F.col("edge_idx").alias("target"), F.lit(True).alias("gated"))
    own = circuits.select("circuit_id", F.col("revision").alias("start"), F.col("nodes").alias("n_nodes"), F.col("edges").alias("n_edges"), "has_memory")
    known = F.col("n_nodes").isNotNull()
    invalid = (
        F.when(~known, "unknown_circuit").when(~op.isin(*OPERATIONS) | op.isNull(), "unknown_operation")
        .when(~((op == "transient_current") & F.col("target").isNull()) & ~F.coalesce(F.col("target").between(0, targets - 1), F.lit(False)), "invalid_target")
        .when(~finite(amount), "invalid_value")
        .when((op == "scale_conductance") & (amount < 0), "invalid_value")
        .when((op == "add_neighborhood") & ~(F.col("max_tier").between(1, 2) & F.col("falloff").between(0, 1)), "invalid_value")
        .when((op == "set_gate_threshold") & F.col("slope").isNotNull() & (~finite(F.col("slope")) | (F.col("slope") == 0)), "invalid_value")
        .when((op == "set_gate_bounds") & ~F.coalesce(finite(F.col("amount2")) & (amount >= 0) & (amount <= F.col("amount2")), F.lit(False)), "invalid_value")
        .when((op == "transient_current") & ~F.coalesce((F.trim("term_id") != "") & (F.col("duration") > 0), F.lit(False)), "invalid_value")
    )
    unavailable = (on_edge & F.col("gated").isNull()) | ((op == "set_memory") & ~F.col("has_memory"))
    return edits.join(own, "circuit_id", "left").join(gated, ["circuit_id", "target"], "left").withColumn("invalid", invalid).withColumn("unavailable", F.coalesce(unavailable, F.lit(False)))


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circuit, revision, terms = None, 0, set()
    for batch in batches:
        x = batch.to_pydict()
        out = []
        for c, e, start, expected, invalid, unavailable, term, known in zip(x["circuit_id"], x["event_idx"], x["start"], x["expected_revision"], x["invalid"], x["unavailable"], x["term"], x["known"], strict=True):
            if c != circuit:
                circuit, revision, terms = c, start or 0, set(known or ())
            reason = invalid
            if reason is None and expected is not None and expected != revision:
                reason = "revision_mismatch"
            elif reason is None and (unavailable or term in terms):
                reason = "target_unavailable"
            if reason is None and term is not None:
                terms.add(term)
            out.append((c, e, reason is None, reason, revision, revision + (reason is None)))
            revision += reason is None
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["circuit_id", "event_idx", "accepted", "reason", "revision_before", "revision_after"])


def judged(edits: DataFrame, circuits: DataFrame, edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The outcome of each edit, with optimistic concurrency.

    An invalid edit is refused before its revision is looked at; one whose revision is not
    the circuit's, or whose target (a gate, a memory, a free term id) isn't there, is refused
    and changes nothing; an accepted one adds one to the revision.
    """
    rows = checked(edits, circuits, edges)
    if terms is None:
        rows = rows.withColumn("known", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(terms.groupBy("circuit_id").agg(F.collect_set("term_id").alias("known")), "circuit_id", "left")
    term = F.when(F.col("operation") == "transient_current", F.col("term_id"))
    cut = rows.select("circuit_id", "event_idx", "start", F.col("expected_revision").cast("bigint").alias("expected_revision"), "invalid", "unavailable", term.alias("term"), "known")
    return cut.repartition("circuit_id").sortWithinPartitions("circuit_id", "event_idx").mapInArrow(_judged, RESULT)


def accepted(edits: DataFrame, results: DataFrame) -> DataFrame:
    return edits.join(results.filter("accepted").select("circuit_id", "event_idx"), ["circuit_id", "event_idx"], "left_semi")


def _folding(low: float, high: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, 0.0
        for batch in batches:
            x = batch.to_pydict()
            values, clamped = [], []
            for c, what, i, start, op, amount in zip(x["circuit_id"], x["what"], x["idx"], x["start"], x["op"], x["amount"], strict=True):
                if (c, what, i) != key:
                    key, value = (c, what, i), start
                raw = amount if op == "set" else value + amount if op == "add" else value * amount
                value = min(max(raw, low), high)
                values.append(value)
                clamped.append(value != raw)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(k)) for k in ("circuit_id", "what", "idx", "event_idx")] + [pa.array(values, pa.float64()), pa.array(clamped, pa.bool_())], ["circuit_id", "what", "idx", "event_idx", "value", "clamped"])

    return run


def folded(ops: DataFrame, low: float, high: float) -> DataFrame:
    """Each operation's value, clamped before the next one: ops(circuit_id, what, idx, event_idx, start, op, amount)."""
    cut = ops.select("circuit_id", "what", "idx", "event_idx", "start", "op", "amount")
    return cut.repartition("circuit_id", "what", "idx").sortWithinPartitions("circuit_id", "what", "idx", "event_idx").mapInArrow(_folding(low, high), "circuit_id bigint, what string, idx bigint, event_idx bigint, value double, clamped boolean")


def voltage_targets(edits: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and amounts of voltage edits; a neighbourhood has the node itself and, by edges of
    either direction, neighbours with the least tier that reaches them."""
    op = F.col("operation")
    own = edits.filter(op.isin("set_voltage", "add_voltage", "add_neighborhood")).select("circuit_id", "event_idx", F.col("target").alias("idx"), F.when(op == "set_voltage", "set").otherwise("add").alias("op"), "amount")
    near = edits.filter(op == "add_neighborhood").select("circuit_id", "event_idx", "target", "amount", "max_tier", "falloff")
    both = edges.select("circuit_id", F.col("from_node").alias("target"), F.col("to_node").alias("idx"), "tier").union(edges.select("circuit_id", F.col("to_node"), F.col("from_node"), "tier"))
    reached = near.join(both, ["circuit_id", "target"]).filter((F.col("tier") <= F.col("max_tier")) & (F.col("idx") != F.col("target")))
    reached = reached.groupBy("circuit_id", "event_idx", "idx", "amount", "falloff").agg(F.min("tier").alias("tier")).filter("falloff > 0")
    return own.union(reached.select("circuit_id", "event_idx", "idx", F.lit("add"), F.col("amount") * F.pow("falloff", F.col("tier"))))


def applied_voltages(edits: DataFrame, nodes: DataFrame, edges: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """The accepted voltage edits, operation by operation."""
    start = nodes.select("circuit_id", F.col("node_idx").alias("idx"), F.col("voltage").alias("start"))
    return folded(voltage_targets(edits, edges).withColumn("what", F.lit("voltage")).join(start, ["circuit_id", "idx"]), low, high)


def scaled_conductances(edits: DataFrame, edges: DataFrame, low: float = 0.0, high: float = 4.0) -> DataFrame:
    """Base and present conductance of all edges at a node, scaled and clamped."""
    scale = edits.filter("operation = 'scale_conductance'").select("circuit_id", "event_idx", F.col("target").alias("node"), "amount")
    ends = edges.select("circuit_id", F.col("edge_idx").alias("idx"), "base", "conductance", F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("node"))
    rows = scale.join(ends, ["circuit_id", "node"])
    what = F.explode(F.array(F.struct(F.lit("base").alias("what"), F.col("base").alias("start")), F.struct(F.lit("conductance").alias("what"), F.col("conductance").alias("start")))).alias("w")
    return folded(rows.select("circuit_id", "event_idx", "idx", "amount", what).select("circuit_id", "event_idx", "idx", "amount", "w.what", "w.start", F.lit("scale").alias("op")), low, high)


def set_memories(edits: DataFrame) -> DataFrame:
    """The memory that nodes are set to, operation by operation."""
    value = clamp(F.col("amount"), 0, 1)
    return edits.filter("operation = 'set_memory'").select("circuit_id", F.lit("memory").alias("what"), F.col("target").alias("idx"), "event_idx", value.alias("value"), (value != F.col("amount")).alias("clamped"))


def latest(values: DataFrame) -> DataFrame:
    """The last value of each thing that operations have changed."""
    return values.groupBy("circuit_id", "what", "idx").agg(F.max_by("value", "event_idx").alias("value"))


def applied_gates(edits: DataFrame, edges: DataFrame) -> DataFrame:
    """Gates after the accepted edits: the last threshold, slope and bounds that were set."""
    set_ = edits.filter(F.col("operation").isin(*GATES))
    when = lambda c, k: F.max_by(c, F.when(k, F.col("event_idx")))
    threshold, bounds = F.col("operation") == GATES[0], F.col("operation") == GATES[1]
    last = set_.groupBy("circuit_id", F.col("target").alias("edge_idx")).agg(when(F.col("amount"), threshold).alias("t"), when(F.col("slope"), threshold & F.col("slope").isNotNull()).alias("s"), when(F.col("amount"), bounds).alias("lo"), when(F.col("amount2"), bounds).alias("hi"))
    out = edges.filter("threshold is not null").join(last, ["circuit_id", "edge_idx"], "left")
    return out.select("circuit_id", "edge_idx", F.coalesce("t", "threshold").alias("threshold"), F.coalesce("s", "slope").alias("slope"), F.coalesce("lo", "low").alias("low"), F.coalesce("hi", "high").alias("high"))


def added_terms(edits: DataFrame) -> DataFrame:
    """The current terms that accepted edits add; a null node means all of the circuit's."""
    return edits.filter("operation = 'transient_current'").select("circuit_id", "term_id", F.lit("constant").alias("kind"), F.col("amount").alias("current"), F.col("target").alias("node_idx"), "start_step", "duration")


def effects(*applied: DataFrame) -> DataFrame:
    """How many things each accepted edit changed, and how many values were clamped."""
    rows = applied[0]
    for more in applied[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("circuit_id", "event_idx").agg(F.countDistinct("idx").alias("affected"), F.count_if("clamped").alias("clamped_values"))
