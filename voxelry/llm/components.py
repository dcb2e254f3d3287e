"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Written
from .workers import mapped


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as stars about the smallest id: the same components, fewer links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars():
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:  # so that a large partition needs no more memory
            yield stars()
    yield stars()


def components(links: DataFrame, native: bool = False) -> DataFrame:
    """doc_id and component (the smallest id that links reach) of every linked id.

    Labels spread along the links and, by looking up the label's own label, along the
    paths that they have made; the rounds grow with the logarithm of the longest path.
    Every round is written down, so its lineage ends there.  ``native``: by DataFrame
    functions only, so links aren't thinned out first.
    """
    stars = links.select("a", "b") if native else links.select("a", "b").transform(mapped, _forest, "a bigint, b bigint")
    edges = Written(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = Written(edges.df.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.df.join(labels.df, edges.df["b"] == labels.df["doc_id"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.df.select("doc_id", "component").join(near, F.col("doc_id") == near["a"]).select("doc_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.df.select(F.col("doc_id").alias("at"), F.col("component").alias("further"))
        new = Written(spread.join(jump, spread["component"] == jump["at"], "left").select("doc_id", "old", F.least("component", "further").alias("component")), "labels")
        labels.drop()
        labels = new
        if not new.df.filter("component <> old").limit(1).count():
            edges.drop()
            return labels.df.select("doc_id", "component")
