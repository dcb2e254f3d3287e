"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled as good) are set against unlabelled web text.  A
linear model over the shape of a text minimises the non-negative unbiased risk

    prior * R(positives as good) + max(0, R(unlabelled as bad) - prior * R(positives as bad))

with the logistic loss, where ``prior`` is the estimated share of good text.  The estimate
comes from the two samples themselves: a first model tells them apart, and the share of good
text is the least ratio of unlabelled to positive mass above a score.  Labels of bad
documents are never looked at.

Training is bounded by ``POSITIVES`` labelled and ``UNLABELLED`` other documents (those with
the smallest hashes of doc_id); features of those rows alone reach the driver.

Edge cases: a null or empty text has features of zero and gets a score like any other; with
no positive at all every score is 0.5; a doc_id with several labels counts as good only if
all of them say so (there alone another label matters); columns other than the id, the text and the labels are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .language import held_out
from .store import table
from .workers import mapped

POSITIVES = 20_000
UNLABELLED = 20_000
STEPS, RATE, DECAY = 500, 0.05, 1e-4

# Classes of bytes whose shares are features.
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n", ".", ",", "!?", "#$%&*@^~", "|", "()[]{}<>", ";:", "\"'`", "-_=+/\\")
_GROUP = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _chars]] = _k + 1
_GROUP[0x80:] = len(_GROUPS) + 1
_N_GROUPS = len(_GROUPS) + 2
N_FEATURES = _N_GROUPS + 17


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


def features(text: W.Text) -> np.ndarray:
    """A row of numbers about the shape of each text."""
    rows = len(text.offsets) - 1
    size = np.diff(text.offsets).astype(np.float64)
    row_of = np.repeat(np.arange(rows), np.diff(text.offsets))
    shares = np.bincount(row_of * _N_GROUPS + _GROUP[text.data], minlength=rows * _N_GROUPS).reshape(rows, _N_GROUPS) / np.maximum(size, 1)[:, None]
    w = W.split(text, W.SPACE_WORD)
    n = np.diff(w.rows).astype(np.float64)
    some = np.maximum(n, 1)
    length = w.lengths.astype(np.float64)
    code, _ = w.coded()
    code = code.astype(np.int64)
    word_row = np.repeat(np.arange(rows), np.diff(w.rows))

    def repeated(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: how many distinct values, and the most frequent one's count."""
        order = np.lexsort((c, r))
        c, r = c[order], r[order]
        fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (r[1:] != r[:-1]))) if len(c) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(c)))
        most = np.zeros(rows)
        np.maximum.at(most, r[first], counts)
        return np.bincount(r[first], minlength=rows).astype(np.float64), most

    distinct, most = repeated(code, word_row)
    pair = np.flatnonzero(word_row[1:] == word_row[:-1]) if len(code) else np.zeros(0, np.int64)
    pairs, _ = repeated(code[pair] * (code.max(initial=0) + 1) + code[pair + 1] if len(pair) else pair, word_row[pair] if len(pair) else pair)
    first_byte = text.data[w.starts] if len(w) else np.zeros(0, np.uint8)
    last_byte = w.data[w.offsets[1:] - 1] if len(w) else np.zeros(0, np.uint8)
    lines = W.split(text, np.arange(256) != 0x0A)
    line_code, _ = lines.coded()
    n_lines = np.diff(lines.rows).astype(np.float64)
    line_row = np.repeat(np.arange(rows), np.diff(lines.rows))
    distinct_lines, _ = repeated(line_code.astype(np.int64), line_row)
    some_lines = np.maximum(n_lines, 1)
    mean = _by_row(length, w.rows) / some
    symbol = np.isin(last_byte, np.frombuffer(b"#$%&*@^~!", np.uint8))
    more = (
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(_by_row(length * length, w.rows) / some - mean * mean, 0)),
        _by_row((length <= 3).astype(float), w.rows) / some, _by_row((length >= 12).astype(float), w.rows) / some,
        distinct / some, most / some, pairs / np.maximum(n - 1, 1), _by_row(symbol.astype(float), w.rows) / some,
        _by_row(((first_byte >= 65) & (first_byte <= 90)).astype(float), w.rows) / some, _by_row((last_byte == 0x2E).astype(float), w.rows) / some,
        np.log1p(n_lines), distinct_lines / some_lines, np.log1p(size / some_lines), np.log1p(n / some_lines), (distinct / some) * np.log1p(n),
    )
    return np.column_stack((shares, *more)).astype(np.float32)


class Model:
    """A logistic model over standardised features and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.column_stack((np.ones(len(x)), z, z * z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -35, 35)))


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Weights that minimise the non-negative unbiased risk, by Adam on the whole sample."""
    both = np.concatenate((positive, unlabelled))
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-6, np.zeros(2 * both.shape[1] + 1), prior)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, m, v = model.weights, 0.0, 0.0
    for step in range(1, STEPS + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -35, 35))), 1 / (1 + np.exp(-np.clip(u @ w, -35, 35)))
        good = p.T @ (sp - 1) / len(p)  # gradient of the positives' loss as good
        rest = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
        bad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)  # of the rest as bad
        g = prior * good + bad if rest >= 0 else -bad  # beneath zero: step back
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good text: of unlabelled against positive mass above a score, the least.

    Every such ratio is at least that share.  Each half of the texts is scored by a model of
    the other half.  The cut is chosen by the ratio and its standard error, so that a chance
    low among few texts doesn't count.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    p, u = [], []
    for k in (0, 1):
        model = fitted(positive[1 - k :: 2], unlabelled[1 - k :: 2], 0.5)
        p.append(model.scores(positive[k::2]))
        u.append(model.scores(unlabelled[k::2]))
    p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    above = lambda x, t: 1 - np.searchsorted(x, t) / len(x)
    best = (np.inf, 0.5)
    for t in cuts:
        a, b = above(u, t), above(p, t)
        if b > 0.1:
            error = a / b * np.sqrt((1 - b) / (b * len(p)) + (1 - a) / (max(a, 1e-9) * len(u)))
            best = min(best, (a / b + error, a / b))
    return float(np.clip(best[1], 0.05, 0.98))


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in W.chunks(batch.column(1)):
            x = features(text)
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(x)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), flat)], ["good", "x"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from labelled positives and all of ``docs`` as unlabelled text."""
    one = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__label"))
    n_good = one.filter(F.col("__label") == 1).count()
    n_docs = docs.filter(F.col(doc_id).isNotNull()).count()
    if not n_good or not n_docs:
        return None
    hashed = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    good = one.filter(F.col("__label") == 1).filter(hashed(F.col("__id"), 11) <= min(1.0, positives / n_good)).select("__id")
    # About POSITIVES ids at most.
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(good), F.col("__doc") == F.col("__id"), "left")
    chosen = rows.filter(F.col("__id").isNotNull() | (hashed(F.col("__doc"), 13) <= min(1.0, unlabelled / n_docs)))
    kind = F.col("__id").isNotNull().cast("int") + 2 * (hashed(F.col("__doc"), 13) <= min(1.0, unlabelled / n_docs)).cast("int")
    # About POSITIVES + UNLABELLED rows of N_FEATURES numbers.
    got = chosen.select(kind.alias("good"), "__text").transform(mapped, _featured, "good int, x array<float>").toArrow()
    kind_of = got.column("good").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
    order = np.lexsort((*x.T[:8], kind_of))  # the same sums in any order of rows
    x, kind_of = x[order], kind_of[order]
    p, u = x[kind_of % 2 == 1], x[kind_of >= 2]
    if not len(p) or not len(u):
        return None
    return fitted(p, u, estimated_prior(p, u))


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for text in W.chunks(batch.column(1)):
                n = len(text.offsets) - 1
                s = model.scores(features(text)) if model is not None else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, n), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The score (0 to 1, higher: better) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).transform(mapped, _scored(shared), "doc_id bigint, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = ~held_out()
    model = train(docs.filter(seen), table(spark, sf_dir, "labels").filter(seen))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
