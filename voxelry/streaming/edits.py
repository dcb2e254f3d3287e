"""Edits and events as streams (an extension: the batch operators hold the semantics)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edits import OPERATIONS

RESULT = "circuit_id long, event_idx long, accepted boolean, reason string, revision_before long, revision_after long"


def applied_edits(edits: DataFrame, nodes: int) -> DataFrame:
    """T14 over a stream: each circuit's revision is kept between batches.

    edits(circuit_id, event_idx, expected_revision or null for any, operation, target,
    amount), all of them on nodes; within a batch a circuit's edits are taken by event_idx.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("event_idx")
        out = []
        for e in rows.itertuples():
            reason = None
            if e.operation not in OPERATIONS:
                reason = "unknown_operation"
            elif not 0 <= e.target < nodes:
                reason = "invalid_target"
            elif e.amount is None or not math.isfinite(e.amount):
                reason = "invalid_value"
            elif not pd.isna(e.expected_revision) and e.expected_revision != revision:
                reason = "revision_mismatch"
            after = revision + (reason is None)
            out.append((key[0], e.event_idx, reason is None, reason, revision, after))
            revision = after
        state.update((revision,))
        yield pd.DataFrame(out, columns=["circuit_id", "event_idx", "accepted", "reason", "revision_before", "revision_after"])

    return edits.groupBy("circuit_id").applyInPandasWithState(run, RESULT, "revision long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, late rows up to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
