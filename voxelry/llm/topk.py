"""Exact top-k inner products by a three-phase uniform threshold.

Each partition of the candidates is a node that holds, for every query, one list of
partial scores for each of ``PARTS`` blocks of dimensions.

1. Every node takes the best entries of each of its lists and sends the k best totals
   among them.  The k-th best total over all nodes is a safe cutoff: k candidates reach it.
2. The cutoff of each query is broadcast.  An entry whose partial scores all lie below
   cutoff / PARTS cannot reach it, so a node collects only those with one at least as high.
3. The totals of these are resolved exactly, and those at or above the cutoff, at most k
   for each query and node, are sent and ranked.

The queries are a stated set that goes through in blocks of ``BLOCK_VALUES`` values, each
broadcast by itself, so its size has no bound.  Cutoffs are merged by slices of queries
on the executors; the driver sees one number for each query of a block.

What it costs: exact scores need every query against every candidate, and each block reads
the candidates twice, once for the cutoff and once for the rest.  The threshold doesn't save
products; it bounds what a node holds, sends and ranks to some k for each query, whatever
the number of candidates.  Where the queries are a share of the table, the work grows with
its square.

Edge cases: vectors that are null, or hold null or non-finite components, and rows without
an id take no part; a query meets only vectors of its own length, and no row of its own
id; a query id that occurs more than once asks once, with its smallest vector; a repeated
candidate row ranks as often as it occurs; scores beyond a long are set to its bounds;
columns other than the id and the vector are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, written
from .workers import mapped

K = 10
PARTS = 4
SCALE = 1024
#: Components of the queries that are broadcast at once.
BLOCK_VALUES = 1 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20
SLICE = 256

_LEAST = np.iinfo(np.int64).min
RESULT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that take part."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.filter(e.isNotNull() & F.col(vec_id).isNotNull()).filter(~bad)
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def _bound(x: np.ndarray, q: np.ndarray) -> float:
    """No inner product of rows of x and q is greater."""
    return (float(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * (float(np.abs(q.astype(np.float64)).max(initial=0)) + 1) * max(1, x.shape[1])


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with those of q."""
    bound = _bound(x, q)
    if bound < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return x @ q.T
    wide = x.astype(object) @ q.astype(object).T
    return np.clip(wide, _LEAST, np.iinfo(np.int64).max).astype(np.int64)


def _rows(batches: Iterable[pa.RecordBatch], dims: int, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and components of the vectors of ``dims`` components, some at a time."""
    step = max(1, SCORES // max(1, queries))
    for batch in batches:
        lists = batch.column(1)
        offs = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        own = np.flatnonzero(np.diff(offs) == dims)
        ids = batch.column(0).to_numpy()
        for at in range(0, len(own), step):
            k = own[at : at + step]
            yield ids[k], flat[offs[k][:, None] + np.arange(dims)]


def _partials(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    if _bound(x, q) >= 2.0**62:  # sums of parts could overflow: one list of whole scores
        return [_product(x, q)]
    cuts = np.linspace(0, x.shape[1], min(PARTS, max(1, x.shape[1])) + 1).astype(int)
    return [_product(x[:, a:b], q[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _total(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _lists(shared, k: int):
    """Phase 1: the k best totals among the best entries of each local list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = np.full((k, len(ids)), _LEAST, np.int64)
        for own, x in _rows(batches, q.shape[1], len(ids)):
            parts = _partials(x, q)
            total = np.where(own[:, None] == ids[None, :], _LEAST, _total(parts))
            if len(own) > k:
                # Rows that are among the k best of a list; a row counts once for each query.
                seen = np.full(total.shape, _LEAST, np.int64)
                for p in parts:
                    top = np.argpartition(p, len(own) - k, axis=0)[-k:]
                    np.put_along_axis(seen, top, np.take_along_axis(total, top, axis=0), axis=0)
                total = np.partition(seen, len(own) - k, axis=0)[-k:]
            best = np.sort(np.concatenate((best, total)), axis=0)[-k:]
        for s in range(0, len(ids), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s // SLICE], pa.int32()), pa.array([np.ascontiguousarray(best[:, s : s + SLICE]).tobytes()], pa.binary())], ["slice", "best"])

    return run


def _merged(k: int):
    """The k-th best of each query of a slice, over all nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64).reshape(k, -1)
                best[s] = np.sort(np.concatenate((best[s], own)), axis=0)[-k:] if s in best else own
        for s, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.ascontiguousarray(np.sort(own, axis=0)[0]).tobytes()], pa.binary())], ["slice", "best"])

    return run


def _resolved(shared, cut, k: int):
    """Phases 2 and 3: entries that can reach the cutoff, and those that do."""

    def first(query, vec, score):
        order = np.lexsort((vec, np.invert(score), query))
        query, vec, score = query[order], vec[order], score[order]
        begin = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - begin < k
        return query[keep], vec[keep], score[keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        least = cut.value
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for own, x in _rows(batches, q.shape[1], len(ids)):
            parts = _partials(x, q)
            # cutoff / parts, rounded down: nothing that can reach the cutoff is below it.
            share = least // len(parts)
            some = parts[0] >= share
            for p in parts[1:]:
                some |= p >= share
            row, col = np.nonzero(some & (own[:, None] != ids[None, :]))
            score = _total([p[row, col] for p in parts])
            ok = score >= least[col]
            held = first(*(np.concatenate((a, b)) for a, b in zip(held, (col[ok], own[row[ok]], score[ok]), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of one length each, at most BLOCK_VALUES components at a time."""
    waiting: dict[int, list] = {}
    for r in queries.toLocalIterator():
        own = waiting.setdefault(len(r["v"]), [])
        own.append((r["vec_id"], r["v"]))
        if len(own) * max(1, len(r["v"])) >= BLOCK_VALUES:
            block = waiting.pop(len(r["v"]))
            yield np.array([x for x, _ in block], np.int64), np.array([v for _, v in block], np.int64).reshape(len(block), -1)
    for block in waiting.values():
        yield np.array([x for x, _ in block], np.int64), np.array([v for _, v in block], np.int64).reshape(len(block), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    Both have the columns of ``scaled``; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    parts: list[DataFrame] = []
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    pending = None
    for block in _blocks(asked):
        if pending is not None:  # more than one block: each is written before the next
            parts.append(written(pending, "topk"))
        shared = sc.broadcast(block)
        lists = vectors.transform(mapped, _lists(shared, k), "slice int, best binary")
        merged = lists.repartition("slice").transform(mapped, _merged(k), "slice int, best binary").collect()
        least = np.full(len(block[0]), _LEAST, np.int64)
        for r in merged:
            own = np.frombuffer(r["best"], np.int64)
            least[r["slice"] * SLICE : r["slice"] * SLICE + len(own)] = own
        pending = vectors.transform(mapped, _resolved(shared, sc.broadcast(least), k), RESULT_SCHEMA)
    if pending is None:
        parts.append(spark.createDataFrame([], RESULT_SCHEMA))
    else:
        parts.append(pending)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
