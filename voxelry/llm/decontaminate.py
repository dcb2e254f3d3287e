"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the training texts into *segments*.  A segment is a small
positional inverted index of some whole documents: its distinct words, and for each the
sorted list of places where it stands.  Segments are rows of a DataFrame, so the index
can be written, read again and searched for another benchmark later.

``search`` writes the index down and answers phrase and proximity queries on every segment
by itself: of the windows of the test items, those whose rarest word is in the segment, the
posting lists of the words are intersected, offset-adjusted, from the rarest word of that
segment on.  Documents never leave their segment, so there is no shuffle and no skew; the
only thing sent around is the test set.  It is measured first: up to ``BLOCK_BYTES`` it is
broadcast whole, and beyond that it goes in blocks of that size, whose findings are merged
by segment and row.  Either way the stored index is all that is read again.

Edge cases: null or empty texts (documents or items) have no words, so they neither hit
nor are hit; items without an id are left out, rows of one item id count as one item;
a repeated document row is a document of its own;
columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import small, table, written
from .workers import mapped

WINDOW = 10
#: Test texts, in bytes, that are searched for in one pass: what a task holds of them.
BLOCK_BYTES = 8 << 20
#: Windows that are looked at together.
WINDOWS_AT_ONCE = 1 << 16
#: Free places between documents, so that no phrase or neighbourhood spans two of them.
GAP = 64
#: How far from its place a word may stand in a proximity match.
SLOP = 2

INDEX_SCHEMA = "doc_ids array<bigint>, n_words array<bigint>, terms array<binary>, posting_ends binary, positions binary, segment string"
MATCH_SCHEMA = "doc_id bigint, item_id bigint, doc_start bigint, length int, kind string"
RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near_items bigint"
FOUND_SCHEMA = "segment string, row bigint, doc_id bigint, n_words bigint, hits binary, items array<bigint>, near array<bigint>"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for text in W.chunks(batch.column(1)):
            w = W.split(text, W.ALNUM_WORD, lower=True)
            code, terms = w.coded()
            counts = np.diff(w.rows)
            place = np.arange(len(w), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32) * GAP, counts)
            by_term = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(terms))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.slice(text.first, len(counts))], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.binary())),
                    pa.array([ends.tobytes()], pa.binary()),
                    pa.array([place[by_term].tobytes()], pa.binary()),
                    pa.array([uuid.uuid4().hex]),
                ],
                ["doc_ids", "n_words", "terms", "posting_ends", "positions", "segment"],
            )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of the texts: one row for each segment of whole documents."""
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).transform(mapped, _segments, INDEX_SCHEMA)


def stored(index: DataFrame) -> DataFrame:
    """The index in storage: built once, searched as often as there are blocks of test items."""
    return written(index, "index")


class Phrases:
    """The windows of some test items: places in their words, which are numbered.

    A window is where it begins among all words of the items; each is filed under its
    *anchor*, the word of it that is rarest in the items.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        vocabulary: dict[bytes, int] = {}
        parts, owner = [], []
        for item, text in items:
            if item is None or not text:
                continue
            raw = text.encode()
            w = W.split(W.Text(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), W.ALNUM_WORD, lower=True)
            if len(w):
                parts.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w.arrow().to_pylist()], np.int32))
                owner.append(item)
        self.vocabulary = pa.array(list(vocabulary), pa.binary())
        sizes = np.array([len(p) for p in parts], np.int64)
        #: The words of all items back to back, and a row of none behind them.
        self.words = np.concatenate([*parts, np.full(window, -1, np.int32)]) if parts else np.zeros(0, np.int32)
        counts = np.maximum(sizes - window + 1, 1) if parts else sizes
        begins = np.cumsum(sizes) - sizes
        self.starts = W.ranges(begins, counts)
        self.lengths = np.repeat(np.minimum(sizes, window), counts)
        self.items = np.repeat(np.array(owner, np.int64), counts)
        self.anchors, self.anchor_ends = np.zeros(0, np.int64), np.zeros(len(vocabulary), np.int64)
        if parts:
            seen = np.append(np.bincount(self.words[self.words >= 0], minlength=len(vocabulary)), np.iinfo(np.int64).max)
            rarest, anchor = np.full(len(self.starts), np.iinfo(np.int64).max), np.zeros(len(self.starts), np.int64)
            for k in range(window):
                word = np.where(k < self.lengths, self.words[self.starts + k], -1)
                less = seen[word] < rarest
                rarest, anchor = np.where(less, seen[word], rarest), np.where(less, word, anchor)
            self.anchors = np.argsort(anchor, kind="stable")
            self.anchor_ends = np.cumsum(np.bincount(anchor, minlength=len(vocabulary)))

    def filed(self, words: np.ndarray) -> np.ndarray:
        """The windows whose anchors are among the given words."""
        begins = np.concatenate(([0], self.anchor_ends[:-1])) if len(self.anchor_ends) else self.anchor_ends
        return self.anchors[W.ranges(begins[words], self.anchor_ends[words] - begins[words])]


class Lists:
    """The posting lists of a segment, one behind the other: sorted by term and place."""

    #: More than any place of a segment.
    FAR = 1 << 40

    def __init__(self, ends: np.ndarray, positions: np.ndarray):
        self.ends, self.positions = ends.astype(np.int64), positions
        self.begins = np.concatenate(([0], self.ends[:-1])) if len(ends) else self.ends
        self.sizes = self.ends - self.begins
        self.keys = np.repeat(np.arange(len(ends), dtype=np.int64) * self.FAR, self.sizes) + positions

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term's list has a place that is at most ``slop`` off."""
        low = term * self.FAR + np.maximum(place - slop, 0)
        k = np.searchsorted(self.keys, low)
        return (place + slop >= 0) & (self.keys[np.minimum(k, len(self.keys) - 1)] <= term * self.FAR + place + slop) & (k < len(self.keys))


def _intersected(phrases: Phrases, numbers: np.ndarray, lists: Lists, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows, and the places where they start, by intersecting offset-adjusted lists.

    ``numbers``: the segment's term for each word of the test vocabulary, or -1.  Only
    windows whose anchor is in the segment are looked at, and of these only the ones whose
    words all are; the list of the word that is rarest in the segment gives the places, and
    the other words' lists, from rare to frequent, thin them out.  With ``slop``, each word
    may stand so far from where the rarest one expects it.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    candidates = phrases.filed(np.flatnonzero(numbers >= 0))
    for at in range(0, len(candidates), WINDOWS_AT_ONCE):
        live = candidates[at : at + WINDOWS_AT_ONCE]
        place = np.arange(phrases.window)
        inside = place < phrases.lengths[live, None]
        words = np.where(inside, phrases.words[phrases.starts[live, None] + place], -1)
        terms = np.where(words >= 0, numbers[words], -1)
        whole = ((terms >= 0) | ~inside).all(axis=1)
        live, terms = live[whole], terms[whole]
        if not len(live):
            continue
        size = np.where(terms >= 0, lists.sizes[terms], np.iinfo(np.int64).max)
        order = np.argsort(size, axis=1, kind="stable")  # rarest first
        rarest = order[:, 0]
        pivot = terms[np.arange(len(live)), rarest]
        counts = lists.sizes[pivot]
        which = np.repeat(np.arange(len(live)), counts)
        start = lists.positions[W.ranges(lists.begins[pivot], counts)].astype(np.int64) - rarest[which]
        for rank in range(1, phrases.window):
            k = order[which, rank]
            term = terms[which, k]
            ok = (term < 0) | lists.near(np.maximum(term, 0), start + k, slop)
            which, start = which[ok], start[ok]
            if not len(which):
                break
        found.append((live[which], start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _found(index: Iterable[pa.RecordBatch], phrases: Phrases, slop: int) -> Iterator[tuple]:
    """For each segment: its id, and ids, words, row bases, (window, start) of phrases, and of near ones."""
    for batch in index:
        for k in range(batch.num_rows):
            ids, counts = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
            ends = np.frombuffer(batch.column(3)[k].as_py(), np.int32)
            positions = np.frombuffer(batch.column(4)[k].as_py(), np.int32)
            base = np.concatenate(([0], np.cumsum(counts)[:-1])) + np.arange(len(counts)) * GAP if len(counts) else np.zeros(0, np.int64)
            none = np.zeros(0, np.int64)
            exact, near = (none, none), (none, none)
            if len(positions) and len(phrases.starts):
                own = pc.index_in(batch.column(2)[k].values, value_set=phrases.vocabulary).to_numpy(zero_copy_only=False)
                numbers = np.full(len(phrases.vocabulary), -1, np.int64)
                has = np.flatnonzero(~np.isnan(own))
                numbers[own[has].astype(np.int64)] = has
                lists = Lists(ends, positions)
                exact = _intersected(phrases, numbers, lists, 0)
                near = _intersected(phrases, numbers, lists, slop) if slop else exact
            yield batch.column(5)[k].as_py(), ids, counts, base, exact, near


def _marked(lengths: np.ndarray, base: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged covered places: document row of each run, and its (start, length) there."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + lengths)[order])
    fresh = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:] - 1, [len(start) - 1])).astype(np.int64) if len(start) else first
    row = np.searchsorted(base, start[first], side="right") - 1
    return row, np.stack((start[first] - base[row], end[last] - start[first]), axis=1) if len(first) else np.zeros((0, 2), np.int64)


def _items_by_row(phrases: Phrases, base: np.ndarray, window: np.ndarray, start: np.ndarray) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    row = np.searchsorted(base, start, side="right") - 1
    for r, item in set(zip(row.tolist(), phrases.items[window].tolist(), strict=True)):
        out.setdefault(r, set()).add(item)
    return out


def _digest(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _result(ids, counts, hit, items, near) -> pa.RecordBatch:
    n = np.array([len(x) for x in items], np.int64)
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()) if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(n), pa.array([_digest(x) for x in items], pa.string()), pa.array(np.asarray(hit) > 0), pa.array([len(x) for x in near], pa.int64())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"],
    )


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str | None]]]:
    rows = items.select(F.col(item_id).cast("bigint"), F.col(text))
    if (rows.agg(F.sum(F.length(F.col(text)) + 16)).first()[0] or 0) <= limit:
        yield [tuple(x) for x in rows.collect()]
        return
    block, size = [], 0
    for x in rows.toLocalIterator():
        block.append(tuple(x))
        size += len(x[1] or "") + 16
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every phrase match, and every proximity match that is no phrase match, as a row."""
    assert 0 <= slop + window <= GAP
    parts = []
    index = stored(index)
    for block in _blocks(items, item_id, text, block_bytes):
        shared = index.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def run(batches, shared=shared):
            phrases = shared.value
            for _, ids, _, base, exact, near in _found(batches, phrases, slop):
                rows = []
                done = set(zip(exact[0].tolist(), exact[1].tolist(), strict=True))
                seen = {(w, s, "phrase") for w, s in done} | {(w, s, "proximity") for w, s in zip(near[0].tolist(), near[1].tolist(), strict=True) if (w, s) not in done}
                for w, s, kind in sorted(seen):
                    r = int(np.searchsorted(base, s + slop * (kind == "proximity"), side="right")) - 1
                    rows.append((ids[r].as_py(), int(phrases.items[w]), s - int(base[r]), int(phrases.lengths[w]), kind))
                cols = list(zip(*sorted(set(rows), key=str), strict=True)) or [[]] * 5  # an item can have a window twice
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "item_id", "doc_start", "length", "kind"])

        parts.append(index.transform(mapped, run, MATCH_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def search(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of the test items each indexed document holds; a row for each document.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items
    with occurring windows, ``n_near_items`` those that occur at least with their words
    up to ``slop`` places displaced.
    """
    assert 0 <= slop + window <= GAP
    sc = index.sparkSession.sparkContext
    index = stored(index)
    blocks = list(_shared_blocks(sc, items, item_id, text, window, block_bytes))
    if len(blocks) == 1:
        shared = blocks[0]

        def whole(batches):
            phrases = shared.value
            for _, ids, counts, base, exact, near in _found(batches, phrases, slop):
                hit = np.zeros(len(counts), np.int64)
                row, runs = _marked(phrases.lengths[exact[0]], base, counts, exact[1])
                np.add.at(hit, row, runs[:, 1])
                own, close = _items_by_row(phrases, base, *exact), _items_by_row(phrases, base, near[0], near[1] + slop)
                yield _result(ids, counts, hit, [own.get(r, ()) for r in range(len(counts))], [close.get(r, ()) for r in range(len(counts))])

        return index.transform(mapped, whole, RESULT_SCHEMA)

    def partial(shared, first):
        def run(batches):
            phrases = shared.value
            for segment, ids, counts, base, exact, near in _found(batches, phrases, slop):
                row, runs = _marked(phrases.lengths[exact[0]], base, counts, exact[1])
                own, close = _items_by_row(phrases, base, *exact), _items_by_row(phrases, base, near[0], near[1] + slop)
                rows = range(len(counts)) if first else sorted({*own, *close})
                cols = list(zip(*((segment, r, ids[r].as_py(), int(counts[r]), runs[row == r].tobytes(), sorted(own.get(r, ())), sorted(close.get(r, ()))) for r in rows), strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["segment", "row", "doc_id", "n_words", "hits", "items", "near"])

        return run

    found = None
    for k, shared in enumerate(blocks):
        part = index.transform(mapped, partial(shared, k == 0), FOUND_SCHEMA)
        found = part if found is None else found.union(part)
    merged = found.groupBy("segment", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def finished(batches):
        for b in batches:
            x = b.to_pydict()
            hit = []
            for n, parts in zip(x["n_words"], x["hits"], strict=True):
                covered = np.zeros(n + 1, np.int64)
                for p in parts:
                    runs = np.frombuffer(p, np.int64).reshape(-1, 2)
                    np.add.at(covered, runs[:, 0], 1)
                    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
                hit.append(int((np.cumsum(covered)[:n] > 0).sum()))
            yield _result(b.column("doc_id"), x["n_words"], hit, x["items"], x["near"])

    return merged.transform(mapped, finished, RESULT_SCHEMA)


def _shared_blocks(sc, items, item_id, text, window, block_bytes):
    """Each block is broadcast as soon as it is read, so the driver holds one at a time."""
    for block in _blocks(items, item_id, text, block_bytes):
        yield sc.broadcast(Phrases(block, window))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold a window of a test item, all columns kept.

    Documents are told apart by ``doc_id``; a document without an id stays.
    """
    found = search(build_index(docs, doc_id, text), items, slop=0).filter("contaminated")
    hit = written(found.select(F.col("doc_id").alias("__hit")).distinct(), "hit")
    return docs.join(small(hit), docs[doc_id].cast("bigint") == hit["__hit"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("n_near_items")
