"""Substring dedup with super-k-mers.

Every window of ``window`` consecutive words has a *minimiser*: the smallest hash among
the ``gram``-word sequences inside it.  Neighbouring windows mostly share theirs, so a
run of windows with one minimiser (a super-k-mer) travels as one packed string to the
bucket of that minimiser, about three words for each window instead of fifty.  Equal
windows have equal minimisers, so all copies of a window meet in one bucket, where
sorting finds them.  Words are coded exactly and windows that sort as equal are compared
word by word, so hashes only route and order.

Skew: a phrase that is in very many windows would send them all to one bucket.  So windows
are first counted by minimiser, over all texts and in a sketch of fixed size; those whose
counter is far above the mean are keyed by the smallest hash in a second, unrelated order
instead, which equal windows share too.  What is left of a hot key is copies of the same
strings.  A string that a task has already packed for a smaller document isn't sent again,
as each of its windows is known to be a repeat, and the receiving task holds each distinct
string once, for the smallest document, and hands on all others as repeats at once.
A partition that is larger than ``PARTITION_BYTES`` is worked off in slices by minimiser.

Edge cases: null and empty texts have no words and keep an empty string; texts of fewer
words than a window lose nothing; rows without a doc_id lose nothing and are compared
with nothing; copies within one document (or rows of the same doc_id) don't count
against each other; columns other than the id and the text are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .sketch import sketch
from .store import table, written
from .workers import mapped

WINDOW = 50
GRAM = 8
#: Text bytes among which a repeated string is sent once.
BATCH_BYTES = 3 << 20
#: Packed bytes that a map task gathers before it sends them on.
SEND_BYTES = 64 << 20
#: Distinct strings' bytes that are sorted at once, and the slices of a larger partition.
PARTITION_BYTES, SLICES = 24 << 20, 64
#: Counters of windows by minimiser, and from how many times the mean a counter is hot.
COUNTERS, HOT, LEAST_HOT = 1 << 20, 64, 1 << 14
#: Bits that say which documents have repeats: 4 MB; more documents only share more bits.
BITS = 1 << 25

_STRINGS, _REPEATS = 0, 1
_HEAD = struct.Struct("<BI")


def _packed(kind: int, docs, keys, starts, more, strings: list[bytes]) -> bytes:
    body = b"".join((np.asarray(docs, "<i8").tobytes(), np.asarray(keys, "<i8").tobytes(), np.asarray(starts, "<i4").tobytes(), np.asarray(more, "<u8").tobytes(), b"\n".join(strings)))
    return _HEAD.pack(kind, len(docs)) + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(blob: bytes):
    kind, n = _HEAD.unpack_from(blob)
    body = zstandard.ZstdDecompressor().decompress(memoryview(blob)[_HEAD.size :])
    at = np.cumsum([0, 8 * n, 8 * n, 4 * n, 8 * n])
    docs, keys, starts, more = (np.frombuffer(body, t, n, int(a)) for t, a in zip(("<i8", "<i8", "<i4", "<u8"), at, strict=False))
    return kind, docs, keys, starts, more, body[at[-1] :]


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    out, have = grams, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(grams) - width + 1], out[width - have : width - have + len(grams) - width + 1])
    return out


def _keys(w: W.Words, window: int, gram: int, hot: np.ndarray | None):
    """Of every window: its row, its first word and its key; None if there is none."""
    counts = np.diff(w.rows)
    per_row = np.maximum(counts - window + 1, 0)
    at = W.ranges(w.rows[:-1], per_row)
    if not len(at):
        return None
    grams = W.gram_hashes(W.word_hashes(w), gram)
    keys = _window_minima(grams, window - gram + 1)[at]
    if hot is not None and len(hot):
        is_hot = np.isin((keys % np.uint64(COUNTERS)).astype(np.int32), hot)
        if is_hot.any():
            second = _window_minima(W.mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), window - gram + 1)[at]
            keys = np.where(is_hot, second, keys)
    return np.repeat(np.arange(len(counts)), per_row), at, keys


def _super_kmers(text: W.Text, window: int, gram: int, hot: np.ndarray):
    """Row, first word, number of windows and key of each super-k-mer, and their strings."""
    w = W.split(text, W.SPACE_WORD)
    found = _keys(w, window, gram, hot)
    if found is None:
        return None
    row, at, m = found
    fresh = np.concatenate(([True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(m)))
    begin = at[first]
    end = begin + size + window - 1
    whole = W.joined(w)
    a, b = w.offsets[begin] + begin, w.offsets[end] + end - 1
    strings = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return row[first], begin - w.rows[row[first]], size, m[first], strings


def hot_keys(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The counters that hold far more windows than the mean; at most COUNTERS / HOT of them."""

    def minimisers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in W.chunks(batch.column(0)):
            found = _keys(W.split(text, W.SPACE_WORD), window, gram, None)
            if found is not None:
                yield found[2]

    counts = sketch(docs.select("text"), minimisers, COUNTERS)
    return np.flatnonzero(counts > max(LEAST_HOT, HOT * float(counts.mean()))).astype(np.int32)


def _send(shared, window: int, gram: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, hot = 0, shared.value

        def flush():
            if not waiting:
                return
            doc, key, start, mini = (np.concatenate([x[k] for x in waiting]) for k in range(4))
            strings = [s for x in waiting for s in x[4]]
            waiting.clear()
            bucket = (W.mixed(mini) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                own = order[ends[b] : ends[b + 1]]
                yield int(b), _packed(_STRINGS, doc[own], key[own], start[own], mini[own], [strings[k] for k in own.tolist()])

        def rows(found):
            for b, blob in found:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text in W.chunks(batch.column(2), BATCH_BYTES):
                found = _super_kmers(text, window, gram, hot)
                if found is None:
                    continue
                row, start, count, mini, strings = found
                doc, key = ids[text.first + row], keys[text.first + row]
                least: dict[bytes, int] = {}
                order = np.argsort(doc, kind="stable")
                stay = np.zeros(len(doc), bool)
                for k, d in zip(order.tolist(), doc[order].tolist(), strict=True):
                    if least.setdefault(strings[k], d) == d:
                        stay[k] = True
                again = np.flatnonzero(~stay)
                if len(again):
                    blob = _packed(_REPEATS, doc[again], key[again], start[again], count[again].astype(np.uint64), [])
                    yield from rows([(int(doc[again[0]] % buckets), blob)])
                keep = np.flatnonzero(stay)
                own = [strings[k] for k in keep.tolist()]
                waiting.append((doc[keep], key[keep], start[keep], mini[keep], own))
                size += sum(map(len, own))
                if size > SEND_BYTES:
                    yield from rows(flush())
                    size = 0
        yield from rows(flush())

    return run


def _same_windows(code: np.ndarray, rows: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each window whose words also start a window of a smaller doc."""
    per_row = np.diff(rows) - window + 1
    at = W.ranges(rows[:-1], per_row)
    # Hashes of 1, 2, 4, ... codes, joined to those of a window.
    part, have, total, got = W.mixed(code.astype(np.uint64) + np.uint64(1)), 1, None, 0
    left = window
    while left:
        if left & have:
            total = part if total is None else total[: len(part) - got] * np.uint64(0xD1342543DE82EF95) + part[got : got + len(part) - got] if got else part
            got += have
            left -= have
        if left:
            part = W.mixed(part[:-have] * np.uint64(0x9E3779B97F4A7C15) + part[have:])
            have *= 2
    h = total[at]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0], at[:0]
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    some = np.flatnonzero(twice[place] == h)
    owner = np.repeat(np.arange(len(rows) - 1), per_row)[some]
    group, at = place[some], at[some]
    order = np.lexsort((doc[owner], group))
    group, at, owner = group[order], at[order], owner[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    same = np.ones(len(group), bool)
    for k in range(window):
        same &= code[at + k] == code[at[head] + k]
    repeat = same & (doc[owner] > doc[owner[head]])
    for g in np.unique(group[~same]):  # unequal windows under one hash: by their words
        least: dict[bytes, int] = {}
        for k in np.flatnonzero(group == g).tolist():
            d = int(doc[owner[k]])
            repeat[k] = d > least.setdefault(code[at[k] : at[k] + window].tobytes(), d)
    return owner[repeat], at[repeat]


class Strings:
    """The distinct strings of some pieces, each for the smallest document that has it."""

    def __init__(self, window: int):
        self.window = window
        #: String: the document, (key, start) of each place that it has there, and the minimiser.
        self.held: dict[bytes, tuple[int, list[tuple[int, int]], int]] = {}
        self.size = 0
        self.repeats: list[tuple[int, int, int, int]] = []

    def add(self, doc, key, start, mini, strings: list[bytes]) -> None:
        held = self.held
        for d, k, s, m, x in zip(doc.tolist(), key.tolist(), start.tolist(), mini.tolist(), strings, strict=True):
            first = held.get(x)
            if first is None:
                held[x] = (d, [(k, s)], m)
                self.size += len(x)
            elif d > first[0]:
                self.repeats.append((d, k, s, x.count(b" ") + 2 - self.window))
            elif d == first[0]:
                first[1].append((k, s))
            else:
                n = x.count(b" ") + 2 - self.window
                self.repeats += [(first[0], *at, n) for at in first[1]]
                held[x] = (d, [(k, s)], m)

    def known(self) -> Iterator[pa.RecordBatch]:
        """The repeats so far, which are handed on."""
        if self.repeats:
            cols = list(zip(*self.repeats, strict=True))
            self.repeats = []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "key", "start", "windows"])

    def emptied(self):
        """All that is held, as document, key, start, minimiser and string of each place."""
        rows = [(d, k, s, m, x) for x, (d, places, m) in self.held.items() for k, s in places]
        self.held, self.size = {}, 0
        doc, key, start, mini, strings = zip(*rows, strict=True)
        return np.array(doc, np.int64), np.array(key, np.int64), np.array(start, np.int64), np.array(mini, np.uint64), list(strings)

    def found(self) -> Iterator[pa.RecordBatch]:
        """The repeats among the distinct strings, by sorting their windows."""
        yield from self.known()
        if not self.held:
            return
        doc = np.array([d for d, *_ in self.held.values()], np.int64)
        text = np.frombuffer(b"\n".join(self.held), np.uint8)
        ends = np.append(np.flatnonzero(text == 0x0A), len(text))
        w = W.split(W.Text(0, text, np.concatenate(([0], ends))), W.SPACE_WORD)
        code, _ = w.coded()
        owner, at = _same_windows(code, w.rows, doc, self.window)
        if not len(owner):
            return
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        fresh = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        places = list(self.held.values())
        for o, a, n in zip(owner[first].tolist(), (at[first] - w.rows[owner[first]]).tolist(), size.tolist(), strict=True):
            self.repeats += [(places[o][0], k, s + a, n) for k, s in places[o][1]]
        yield from self.known()


def _receive(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slices = Strings(window), None

        def divide(doc, key, start, mini, strings):
            part = (W.mixed(mini ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SLICES)).astype(np.int64)
            for s in np.unique(part).tolist():
                at = np.flatnonzero(part == s)
                slices[s].append(_packed(_STRINGS, doc[at], key[at], start[at], mini[at], [strings[k] for k in at.tolist()]))

        for batch in batches:
            for blob in batch.column(1).to_pylist():
                kind, doc, key, start, more, body = _unpacked(blob)
                if kind == _REPEATS:
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(start.astype(np.int64)), pa.array(more.astype(np.int64))], ["doc_id", "key", "start", "windows"])
                elif slices is None:
                    own.add(doc, key, start, more, body.split(b"\n"))
                    if len(own.repeats) > 50_000:
                        yield from own.known()
                    if own.size > PARTITION_BYTES:  # too many distinct strings: go on by slices
                        slices = [[] for _ in range(SLICES)]
                        yield from own.known()
                        divide(*own.emptied())
                else:
                    divide(doc, key, start, more, body.split(b"\n"))
        yield from own.found()
        for blobs in slices or ():
            some = Strings(window)
            for x in blobs:
                _, d, k, s, m, b = _unpacked(x)
                some.add(d, k, s, m, b.split(b"\n"))
                if len(some.repeats) > 50_000:
                    yield from some.known()
            blobs.clear()
            yield from some.found()

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows that also start in a smaller doc_id: doc_id, key, start, windows.

    ``docs``: doc_id bigint, key bigint (tells rows of one doc_id apart), text.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.filter("doc_id is not null")
    shared = spark.sparkContext.broadcast(hot_keys(known, window, gram))  # at most COUNTERS / HOT numbers
    sent = known.transform(mapped, _send(shared, window, gram, buckets), "bucket int, blob binary")
    return sent.repartitionById(buckets, "bucket").transform(mapped, _receive(window), "doc_id bigint, key bigint, start bigint, windows bigint")


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            runs = lists.flatten()
            offs = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            none = lists.is_null().to_numpy(zero_copy_only=False)
            starts, counts = runs.field(0).to_numpy(), runs.field(1).to_numpy()
            total, removed, kept = [], [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                words = text.encode().split() if text else []
                n, gone = len(words), 0
                if not none[k] and n:
                    a, b = starts[offs[k] : offs[k + 1]], counts[offs[k] : offs[k + 1]]
                    order = np.argsort(a)
                    out, at = [], 0
                    for x, y in zip(a[order].tolist(), (a + b + window - 1)[order].tolist(), strict=True):
                        if y <= at:
                            continue
                        out += words[at:x] if x > at else []
                        gone += y - max(x, at)
                        at = y
                    words = out + words[at:]
                total.append(n)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _bit(ids: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a document's bit is, by its id and key."""
    return (W.mixed(ids.astype(np.uint64) ^ W.mixed(keys.astype(np.uint64))) % np.uint64(bits)).astype(np.int64)


#: Bytes of the bit set that travel together.
_SLICE = 1 << 16


def _marked(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n // 8, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), batch.column(1).to_numpy(), n)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        press = zstandard.ZstdCompressor(level=1)
        own = [(k, press.compress(part.tobytes())) for k in range(0, len(bits), _SLICE) if (part := bits[k : k + _SLICE]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // _SLICE for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["slice", "bits"])

    return run


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
            bits[k] = bits[k] | own if k in bits else own
    press = zstandard.ZstdCompressor(level=1)
    yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([press.compress(x.tobytes()) for x in bits.values()], pa.binary())], ["slice", "bits"])


def _with_repeats(runs: DataFrame) -> np.ndarray:
    """A bit for each document that has repeats; a few others may share one."""
    schema = "slice int, bits binary"
    bits = np.zeros(BITS // 8, np.uint8)
    marked = runs.select("doc_id", "key").transform(mapped, _marked(BITS), schema).repartition("slice")
    for r in marked.transform(mapped, _joined, schema).collect():  # BITS at most
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
        bits[r["slice"] * _SLICE : r["slice"] * _SLICE + len(own)] = own
    return bits


def _told_apart(shared, repeats: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            at = _bit(ids.fill_null(0).to_numpy(), keys, 8 * len(bits))
            has = ((bits[at >> 3] >> (at & 7)) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(has if repeats else ~has))

    return run


def _untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in W.chunks(batch.column(2)):
            w = W.split(text, W.SPACE_WORD)
            whole = W.joined(w)
            at = w.offsets[w.rows] + w.rows
            n = np.diff(w.rows)
            kept = [whole[a : b - 1].decode() if b > a else "" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(n)), pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each document without the words of windows that a smaller doc_id has: doc_id,
    n_words, n_removed, and what is kept, its words joined by one space.

    Only documents with repeats are shuffled to them; the others stay where they are.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("key"), F.col(text).alias("text"))
    runs = written(repeated_windows(own, window, gram), "repeats")
    shared = docs.sparkSession.sparkContext.broadcast(_with_repeats(runs))
    schema, result = "doc_id bigint, key bigint, text string", "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    lists = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    some = own.transform(mapped, _told_apart(shared, True), schema).join(lists, ["doc_id", "key"], "left").select("doc_id", "text", "runs")
    rest = own.transform(mapped, _told_apart(shared, False), schema)
    return some.transform(mapped, _kept(window), result).unionByName(rest.transform(mapped, _untouched, result))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
