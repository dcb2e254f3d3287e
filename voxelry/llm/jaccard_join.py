"""N-gram Jaccard self-join, and the components that its links form.

A document's set holds its distinct ``GRAM``-word shingles, as 64-bit hashes.  Documents
with equal sets are one class from the start, and only a class's first document goes on.

Candidates come from rare-first prefixes: two sets of Jaccard similarity t share one of
the first n - ceil(t n) + 1 shingles of either in any common order, and the rarer these
are, the fewer documents meet.  The order goes by counts over all documents, kept in a
sketch of ``COUNTERS`` counters (a fixed size, whatever the corpus), ties by hash.  Prefix
shingles are shuffled by hash; whoever meets there must pass the length filter, the
positional filter and a suffix filter (how many shingles each has in ``RANGES`` ranges of
hashes, modulo 16: the differences add up to no more than the sets differ).  Each pair that is left
is verified once, on the full sets.

Large groups of near copies: pairs inside a group are never all made.  A first round
verifies a few pairs for each document (with the least changed document that shares a
prefix shingle with it, and with its neighbour in length under its rarest one), a second one
pairs the components that have been found, by their least changed members.  The last round
makes only the pairs across the components that are left, so the components are exact, and
what is already linked costs nothing.  So the result is classes and components; links inside
a component are not counted.

Skew: no list of documents under a shingle is ever one task's work.  The first two rounds are
joins with one row for each shingle.  In the last one a list of more than ``BLOCK`` documents
is dealt out by length and by hash, and only the documents that are not in the list's largest
component are sent to the parts that hold documents of a similar length.

Edge cases: null and empty texts have an empty set and link with nothing; texts of fewer
words than a shingle have one shingle; a row without a doc_id is handed on with no
component; rows of one doc_id are one document (with different texts: linked by what any
of their prefixes finds, verified on the smallest set in byte order); columns other than
the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .sketch import sketch
from .store import small, table, written
from .workers import mapped

GRAM = 5
PERCENT = 80
#: Counters of the sketch: 16 MB.
COUNTERS = 1 << 22
RANGES = 256
#: Documents of a list that are compared in one task.
BLOCK = 4096
#: From how many times the mean (and BLOCK) a counter's shingles are dealt to all buckets.
HOT = 64
#: Pairs of one document that are verified in one group.
GROUP = 512

SIGNED = "doc_id bigint, n bigint, digest binary, ranges binary, prefix binary"


def _sets(text: W.Text, gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    w = W.split(text, W.SPACE_WORD, lower=True)
    words = W.word_hashes(w)
    grams = W.gram_hashes(words, gram)
    none = np.zeros(0, np.uint64)
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if b - a >= gram:
            yield np.unique(grams[a : b - gram + 1])
        elif b > a:
            yield W.gram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield none


def shingle_counts(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """In how many documents the shingles of each counter are: over all documents."""

    def shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in W.chunks(batch.column(0)):
            all_ = [s for s in _sets(text, gram) if len(s)]
            if all_:
                yield np.concatenate(all_)

    return sketch(docs.select("text"), shingles, COUNTERS, np.uint32)


def _least(n, percent: int):
    """The least overlap with a set no larger than n that is similar enough."""
    return (percent * n + 99) // 100


def _signed(shared, gram: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for text in W.chunks(batch.column(1)):
                n, digest, ranges, prefix = [], [], [], []
                for s in _sets(text, gram):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    own = s[np.argsort(counts[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")]
                    prefix.append(own[: len(s) - _least(len(s), percent) + 1].tobytes() if len(s) else b"")
                    in_range = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES) % 16
                    ranges.append((in_range[0::2] * 16 + in_range[1::2]).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(n)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(ranges, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n", "digest", "ranges", "prefix"])

    return run


def signed(docs: DataFrame, counts: np.ndarray, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Set size, digest, range counts and rare-first prefix of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    return docs.select("doc_id", "text").transform(mapped, _signed(shared, gram, percent), SIGNED)


_POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _is_hot(token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin((token % np.uint64(COUNTERS)).astype(np.int32), hot) if len(hot) else np.zeros(len(token), bool)


def _posted(shared, buckets: int):
    """Prefix shingles, packed by bucket of their hash; hot ones go to all buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, hot = zstandard.ZstdCompressor(level=1), shared.value
        waiting: list[np.ndarray] = []
        size = 0

        def flush():
            if not waiting:
                return
            all_ = np.concatenate(waiting)
            waiting.clear()
            spread = np.where(_is_hot(all_["token"], hot), W.mixed(all_["doc"].view(np.uint64)), np.uint64(0))
            bucket = (((all_["token"] >> np.uint64(32)) + (spread >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                own = all_[order[ends[b] : ends[b + 1]]]
                # A document's numbers repeat from posting to posting: written column by column they all but vanish.
                raw = b"".join(np.ascontiguousarray(own[k]).tobytes() for k in _POSTING.names)
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([press.compress(raw)], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            data, offsets = W.flat(batch.column(2))
            counts = np.diff(offsets) // 8
            own = np.zeros(int(counts.sum()), _POSTING)
            own["token"] = np.frombuffer(data.tobytes(), "<u8")
            row = np.repeat(np.arange(len(counts)), counts)
            own["doc"] = batch.column(0).to_numpy()[row]
            own["n"] = batch.column(1).to_numpy()[row]
            own["at"] = W.ranges(np.zeros(len(counts), np.int64), counts)
            waiting.append(own)
            size += len(own)
            if size > 500_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(raw)
    out = np.zeros(len(body) // _POSTING.itemsize, _POSTING)
    at = 0
    for k in _POSTING.names:
        size = out[k].nbytes
        out[k] = np.frombuffer(body, _POSTING[k], len(out), at)
        at += size
    return out


_LISTED = "token bigint, doc_id bigint, n int, at int"


def _listed(shared, percent: int):
    """Postings of the shingles that several documents have in their prefixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        blobs = [x for b in batches for x in b.column(1).to_pylist()]  # compressed
        parts = max(1, sum(map(len, blobs)) // (8 << 20))
        for part in range(parts):  # so much at a time that it fits
            own = [_unpacked(x) for x in blobs]
            own = np.concatenate([x[(x["token"] % np.uint64(parts)) == part] for x in own]) if own else np.zeros(0, _POSTING)
            own = own[np.lexsort((own["doc"], own["n"], own["token"]))]
            token = own["token"]
            # Somebody near enough in length must have it too, next in order of length.
            near = (token[1:] == token[:-1]) & (100 * own["n"][:-1].astype(np.int64) >= percent * own["n"][1:].astype(np.int64))
            keep = _is_hot(token, hot)  # of these, others are elsewhere
            keep[1:] |= near
            keep[:-1] |= near
            own = own[keep]
            for k in range(0, len(own), 50_000):
                x = own[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["token"]).view(np.int64)), pa.array(x["doc"]), pa.array(x["n"]), pa.array(x["at"])], ["token", "doc_id", "n", "at"])

    return run


def _halves(raw: np.ndarray) -> np.ndarray:
    """The counts of each range, two to a byte."""
    return np.column_stack((raw >> 4, raw & 15)).reshape(-1, RANGES).astype(np.int8)


def _lists(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The postings of each token, from rows that are sorted by token."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        own = {}
        for k, name in enumerate(columns):
            c = batch.column(k)
            own[name] = _halves(np.frombuffer(W.flat(c)[0].tobytes(), np.uint8)) if name == "ranges" else c.to_numpy(zero_copy_only=False)
        if rest is not None:
            own = {k: np.concatenate((rest[k], v)) for k, v in own.items()}
        token = own["token"]
        if not len(token):
            continue
        ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            if b < len(token):
                yield {k: v[a:b] for k, v in own.items()}
            else:
                rest = {k: v[a:b] for k, v in own.items()}
    if rest is not None:
        yield rest


def _may_link(percent: int, n1, at1, n2, at2, ranges1=None, ranges2=None) -> np.ndarray:
    """Length, positional and suffix filters: false only where two sets can't link and this
    is the first shingle that they share."""
    need = (percent * (n1 + n2) + 99 + percent) // (100 + percent)
    ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - at1, n2 - at2) >= need)
    if ranges1 is not None and ok.any():
        k = np.flatnonzero(ok)
        one = ranges1[k] if ranges1.ndim == 2 else ranges1[None, :]
        two = ranges2[k] if ranges2.ndim == 2 else ranges2[None, :]
        differ = np.abs(one - two)
        differ = np.minimum(differ, 16 - differ).sum(axis=1, dtype=np.int64)  # counts are modulo 16
        ok[k] = differ <= (n1 + n2 - 2 * need)[k]
    return ok


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _pairs_of(percent: int, ranges: bool = False):
    """The pairs of a table that pass the filters: doc_id, n, at and the other's, as rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, at, doc2, n2, at2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            both = [_halves(np.frombuffer(W.flat(batch.column(k))[0].tobytes(), np.uint8)) for k in (6, 7)] if ranges else (None, None)
            ok = _may_link(percent, n.astype(np.int64), at.astype(np.int64), n2.astype(np.int64), at2.astype(np.int64), *both) & (doc != doc2)
            yield _pairs(doc[ok], doc2[ok])

    return run


def _cross_pairs(percent: int):
    """Pairs across components that pass the filters, block against block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _lists(batches, ("token", "doc_id", "n", "at", "component", "ranges")):
            if (own["component"] == own["component"][0]).all():
                continue
            order = np.lexsort((own["doc_id"], own["n"]))
            doc, n, at, ranges, component = (own[k][order] for k in ("doc_id", "n", "at", "ranges", "component"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            for i in range(0, len(doc), BLOCK):
                big = slice(i, i + BLOCK)
                low = int(np.searchsorted(n, (percent * n[i] + 99) // 100))
                for j in range(low, min(i + BLOCK, len(doc)), BLOCK):
                    small = slice(j, min(j + BLOCK, i + BLOCK))
                    for k in range(small.start, min(small.stop, len(doc))):
                        # Who comes after k in the order, and is not too long for it.
                        first = max(k + 1, i)
                        last = min(i + BLOCK, int(np.searchsorted(n, 100 * n[k] // percent, side="right")))
                        if first >= last:
                            continue
                        x = slice(first, last)
                        other = first + np.flatnonzero(component[x] != component[k])
                        if len(other):
                            y = doc[other[_may_link(percent, n[other], at[other], n[k], at[k], ranges[other], ranges[k])]]
                            yield _pairs(np.full(len(y), doc[k]), y)

    return run


def _minor_pairs(percent: int):
    """In each part of a long list: its own documents, which come first, against those that are sent to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            token, band, part, sent, doc, n, at, component = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            ranges = _halves(np.frombuffer(W.flat(batch.column(8))[0].tobytes(), np.uint8))
            n, at = n.astype(np.int64), at.astype(np.int64)
            fresh = np.flatnonzero((token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip(np.append(0, fresh).tolist(), np.append(fresh, len(token)).tolist(), strict=True):
                if a == b:
                    continue
                if key != (token[a], band[a], part[a]):
                    key, own = (token[a], band[a], part[a]), None
                first = a + int(np.searchsorted(sent[a:b], 1))
                if first > a:
                    more = (doc[a:first], n[a:first], at[a:first], component[a:first], ranges[a:first])
                    own = more if own is None else tuple(np.concatenate(x) for x in zip(own, more, strict=True))
                for k in range(first, b) if own is not None else ():
                    other = np.flatnonzero(own[3] != component[k])
                    if len(other):
                        y = own[0][other[_may_link(percent, own[1][other], own[2][other], n[k], at[k], own[4][other], ranges[k])]]
                        yield _pairs(np.full(len(y), doc[k]), y)

    return run


def _bundled(make):
    """Few large batches in place of many small ones."""

    def run(batches):
        waiting, size = [], 0
        for b in make(batches):
            waiting.append(b)
            size += b.num_rows
            if size > 20_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return run


def _set_rows(gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in W.chunks(batch.column(1)):
                sets = [s.tobytes() for s in _sets(text, gram)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "items"])

    return run


def _verified(percent: int):
    """Links among pairs that come sorted by (a, part), a's own set first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, b = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            data, offsets = W.flat(batch.column(3))
            found = []
            for k, other in enumerate(b):
                items = np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), "<u8")
                if other is None:
                    if key != (a[k], part[k]):  # of rows that repeat an id, the first
                        key, own = (a[k], part[k]), items
                    continue
                assert key == (a[k], part[k])
                place = np.minimum(np.searchsorted(own, items), len(own) - 1)
                both = int((own[place] == items).sum()) if len(own) else 0
                if 100 * both >= percent * (len(own) + len(items) - both) and both:
                    found.append((int(a[k]), int(other)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


class Join:
    """The join of one table; intermediate tables are written once and kept for both rounds."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT):
        self.gram, self.percent = gram, percent
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        counts = shingle_counts(self.docs, gram)
        self.hot = np.flatnonzero(counts > max(HOT * BLOCK, HOT * float(counts.mean()))).astype(np.int32)
        self.signed = written(signed(self.docs, counts, gram, percent), "signed")
        some = self.signed.filter("doc_id is not null and n > 0")
        self.classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "classes")

    def firsts(self) -> DataFrame:
        """The classes' first documents."""
        return self.signed.join(self.classes.select("digest", F.col("first").alias("doc_id")), ["digest", "doc_id"], "left_semi")

    def listed(self) -> DataFrame:
        """Their prefix shingles that are shared."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shared = self.spark.sparkContext.broadcast(self.hot)  # at most COUNTERS / HOT numbers
        posted = self.firsts().select("doc_id", "n", "prefix").transform(mapped, _posted(shared, buckets), "bucket int, blob binary")
        return posted.repartitionById(buckets, "bucket").transform(mapped, _listed(shared, self.percent), _LISTED)

    def open_lists(self, listed: DataFrame, joined: DataFrame) -> DataFrame:
        """The postings of shingles that documents of several components share."""
        labelled = listed.join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_ = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
        return labelled.join(open_, "token", "left_semi").select("token", "doc_id", "n", "at", "component")

    def with_ranges(self, rows: DataFrame, of: str = "doc_id", name: str = "ranges") -> DataFrame:
        return rows.join(self.firsts().select(F.col("doc_id").alias(of), F.col("ranges").alias(name)), of)

    def first_pairs(self, listed: DataFrame) -> DataFrame:
        """With the least changed document of each list, and under a document's rarest shingle
        with its neighbour in length."""
        hubs = listed.groupBy("token").agg(F.min(F.struct("at", "doc_id", "n")).alias("h"), F.count("*").alias("size"))
        hubs = written(hubs.select("token", F.col("h.doc_id").alias("doc2"), F.col("h.n").alias("n2"), F.col("h.at").alias("at2"), "size"), "hubs")
        own = ("doc_id", "n", "at", "doc2", "n2", "at2")
        joined = listed.join(hubs, "token")
        star = joined.select(*own)
        rarest = listed.groupBy("doc_id").agg(F.min(F.struct("at", "token")).alias("r")).select("doc_id", F.col("r.token").alias("token"), F.lit(True).alias("first"))
        # A part of a list is as good as the whole: who is nobody's neighbour has the hub.
        order = Window.partitionBy("token", F.pmod(F.xxhash64("doc_id"), F.floor(F.col("size") / BLOCK) + 1)).orderBy("n", "doc_id")
        rows = joined.drop("doc2", "n2", "at2").join(rarest, ["doc_id", "token"], "left")
        before = rows.select("doc_id", "n", "at", "first", *[F.lag(c).over(order).alias(f"{'doc' if c == 'doc_id' else c}2") for c in ("doc_id", "n", "at")])
        near = before.filter("first and doc2 is not null").select(*own)
        return star.union(near).transform(mapped, _pairs_of(self.percent), "a bigint, b bigint")

    def component_pairs(self, rows: DataFrame) -> DataFrame:
        """For each list, its least changed document with that of each other component."""
        least = written(rows.groupBy("token", "component").agg(F.min(F.struct("at", "doc_id", "n")).alias("r")).select("token", "component", "r.*"), "least")
        hubs = least.groupBy("token").agg(F.min(F.struct("at", "doc_id", "n", "component")).alias("h")).select("token", F.col("h.doc_id").alias("doc2"), F.col("h.n").alias("n2"), F.col("h.at").alias("at2"), F.col("h.component").alias("other"))
        both = self.with_ranges(self.with_ranges(least.join(hubs, "token").filter("component <> other").drop("token", "component", "other")), "doc2", "ranges2")
        return both.select("doc_id", "n", "at", "doc2", "n2", "at2", "ranges", "ranges2").transform(mapped, _pairs_of(self.percent, True), "a bigint, b bigint")

    def cross_pairs(self, rows: DataFrame) -> DataFrame:
        """All pairs across components that pass the filters."""
        rows = written(self.with_ranges(rows), "open")
        sizes = rows.groupBy("token").agg(F.count("*").alias("size"))
        long = written(sizes.filter(F.col("size") > BLOCK).select("token"), "long")
        cut = ("token", "doc_id", "n", "at", "component", "ranges")
        short = rows.join(small(long), "token", "left_anti").select(*cut).repartition("token").sortWithinPartitions("token")
        pairs = short.transform(mapped, _bundled(_cross_pairs(self.percent)), "a bigint, b bigint")
        if long.isEmpty():
            return pairs
        # Long lists by bands of length: who links is in the same band or the next.
        band = F.floor(F.log(F.col("n")) / math.log(100 / self.percent)) if self.percent < 100 else F.col("n").cast("long")
        rows = rows.join(small(long), "token", "left_semi").withColumn("band", band)
        parts = written(rows.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "parts")
        largest = rows.groupBy("token", "component").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
        where = ("token", "band", "part", "sent", "doc_id", "n", "at", "component", "ranges")
        own = rows.join(parts, ["token", "band"]).withColumns({"part": F.pmod(F.xxhash64("doc_id"), F.col("parts")), "sent": F.lit(0)}).select(*where)
        minor = rows.join(largest, "token").filter(F.col("component") != F.col("largest")).drop("largest")
        sent = minor.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).join(parts, ["token", "band"])
        sent = sent.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)), "sent": F.lit(1)}).select(*where)
        dealt = own.union(sent).repartition("token", "band", "part").sortWithinPartitions("token", "band", "part", "sent")
        return pairs.union(dealt.transform(mapped, _bundled(_minor_pairs(self.percent)), "a bigint, b bigint"))

    def verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links."""
        pairs = written(pairs.distinct(), f"{label}-pairs")
        ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{label}-ids")
        sets = written(self.docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text").transform(mapped, _set_rows(self.gram), "doc_id bigint, items binary"), f"{label}-sets")
        # A document with many pairs is verified in several groups, each with its own copy of the set.
        parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), f"{label}-parts")
        asked = written(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"), f"{label}-asked")
        # Pairs are broadcast to the sets while they are few, so that each set moves once for each pair.
        others = sets.join(small(asked), asked["b"] == sets["doc_id"]).select("a", "part", "b", "items")
        own = sets.join(small(parts), parts["a"] == sets["doc_id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "items")
        grouped = others.union(own).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first(), "items")
        return grouped.transform(mapped, _verified(self.percent), "a bigint, b bigint").distinct()

    def links(self) -> DataFrame:
        """Verified links (a, b), a < b, between classes' first documents, as far as needed:
        all links across what the first two rounds have joined, and enough to join that."""
        listed = written(self.listed(), "listed")
        links = written(self.verified(self.first_pairs(listed), "first"), "first-links")
        for label, make in (("component", self.component_pairs), ("cross", self.cross_pairs)):
            found = self.verified(make(self.open_lists(listed, components(links))), label)
            links = written(links.union(found), f"{label}-links")
        return links

    def membership(self) -> DataFrame:
        """doc_id, n_shingles, class_id and component_id of every row."""
        joined = components(self.links())
        known = self.classes.join(joined.withColumnRenamed("doc_id", "first"), "first", "left").select("digest", "first", F.coalesce("component", "first").alias("component"))
        rows = self.signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
        return rows.join(known, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Every document with its class and component."""
    return Join(docs, doc_id, text, gram, percent).membership()


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The first document (smallest id) of each component; documents with empty sets or no
    id all stay, and a repeated row stays as often as it occurs."""
    found = near_duplicates(docs, doc_id, text, gram, percent)
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small(gone), docs[doc_id].cast("bigint") == gone["__gone"], "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), gram=4, percent=85).select("doc_id", "n_shingles", "component_id")
