"""Packing token streams into fixed-length sequences: concatenate and cut.

Pass 1 tokenises each document once and writes its ids, together with the input
partition that it came from and its offset among that partition's tokens.  The prefix
sum over the partitions' totals (one number for each partition) then turns local offsets
into places in one global stream, without any sort or shuffle of the documents.  Pass 2
cuts the stream at multiples of the sequence length: a document that lies across a
boundary gives a boundary record on either side.  Only the very last sequence can need
padding.

Tokenising is exact but works on the distinct chunks of a batch: text is cut at places
where the tokenizer's own pre-tokenizer always cuts, each distinct chunk is encoded once,
and the ids are put together again by array operations.  Documents with the marker of a
special token are encoded whole.

Edge cases: a null text counts as empty and gives the end id alone; an empty table gives
no rows; repeated rows are packed as often as they occur; columns other than the id and
the text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Written, small, table, written
from .workers import mapped

LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Chunks whose ids a Python worker remembers between batches, twice (about 150 bytes each).
CACHED = 220_000
#: Text bytes that are tokenised at once.
TOKENISED = 2 << 20

TOKENS_SCHEMA = "doc_id bigint, ids binary, n_tokens bigint, part bigint, local_start bigint"
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

# Byte classes: white space, ASCII letter, ASCII digit, other ASCII, beyond ASCII.
_SPACE, _LETTER, _DIGIT, _OTHER, _WIDE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[~W.SPACE_WORD] = _SPACE
for _a, _b, _k in ((0x41, 0x5B, _LETTER), (0x61, 0x7B, _LETTER), (0x30, 0x3A, _DIGIT), (0x80, 0x100, _WIDE)):
    _CLASS[_a:_b] = _k


class Encoder:
    """Ids of texts by a tokenizer file whose pre-tokenizer keeps letters, single digits
    and other signs apart, drops white space and lower-cases (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)  # for chunks of lower-case ASCII letters alone
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Which ids end a word: many words go in as one text, and are told apart by these.
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        if suffix:
            self.ends[[k for t, k in self.full.get_vocab().items() if t.endswith(suffix)]] = True
        self.marks = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.full.get_added_tokens_decoder().values()) or b"(?!)")
        self.kind = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, as the bytes of numbers of ``kind``."""
        if len(self.known) > CACHED:  # what is asked for again comes over from the former ones
            self.known, self.former = {}, self.known
        known, former = self.known, self.former
        missed = [c for c in chunks if c not in known]
        known.update((c, former[c]) for c in missed if c in former)
        new = [c for c in missed if c not in former]
        simple = [c for c in new if c.isalpha()]  # of bytes: ASCII letters only
        other = [c for c in new if not c.isalpha()]
        for at in range(0, len(simple), 1000):
            some = simple[at : at + 1000]
            if not self._together(some):
                other += some
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            got = self.full.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)
            known.update((c, np.array(e.ids, self.kind).tobytes()) for c, e in zip(some, got, strict=True))
        return list(map(known.__getitem__, chunks))

    def _together(self, words: list[bytes]) -> bool:
        """Encodes words as one text; false if their ids can't be told apart."""
        got = self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(got[0].ids, self.kind)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
        if len(cuts) != len(words):
            return False
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, cuts.tolist(), strict=True):
            self.known[word] = raw[at:end]
            at = end
        return True

    def ids(self, text: W.Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows back to back, and how many each row has."""
        rows = len(text.offsets) - 1
        if not len(text.data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        data, offsets = W.LOWER[text.data], text.offsets
        kind = _CLASS[data]
        solid = kind != _SPACE
        cut = np.ones(len(data), bool)  # a chunk begins here
        a, b = kind[:-1], kind[1:]
        cut[1:] = (a != b) & (a != _WIDE) & (b != _WIDE) | (a == _DIGIT) & (b != _WIDE)
        cut[1:] &= ~((data[:-1] == 0x27) & (b == _LETTER))
        cut[1:] |= a == _SPACE
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = np.flatnonzero(cut & solid)
        ends = np.zeros(int(solid.sum()) + 1, np.int64)
        sums = np.cumsum(solid, dtype=np.int64)
        at = np.append(sums[begins] - 1, ends.size - 1)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data[solid])])
        by_row = np.searchsorted(begins, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        coded = chunks.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = self.chunk_ids(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in own], np.int64) // self.kind.itemsize
        places = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(own), self.kind).astype(np.uint32)
        ids = pool[W.ranges(places[code], sizes[code])]
        counts = np.concatenate(([0], np.cumsum(sizes[code])))
        counts = counts[by_row[1:]] - counts[by_row[:-1]]
        marked = sorted({int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in self.marks.finditer(text.data.tobytes())})
        if marked:
            parts, ends = [], np.concatenate(([0], np.cumsum(counts)))
            for r in range(rows):
                x = ids[ends[r] : ends[r + 1]]
                if r in marked:
                    x = np.array(self.full.encode(text.data[offsets[r] : offsets[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    counts[r] = len(x)
                parts.append(x)
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit), its partition, and its offset there."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), 0
        encode = encoder(path)
        for batch in batches:
            for some in W.chunks(batch.column(1), TOKENISED):
                ids, counts = encode.ids(some)
                at = np.concatenate(([0], np.cumsum(counts)))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    counts = counts + 1
                    at = np.concatenate(([0], np.cumsum(counts)))
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(some.first, len(counts)).cast(pa.int64()), raw, pa.array(counts), pa.array(np.full(len(counts), part, np.int64)), pa.array(sent + at[:-1])], ["doc_id", "ids", "n_tokens", "part", "local_start"])
                sent += int(at[-1])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).transform(mapped, run, TOKENS_SCHEMA)


def _pieces(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.flat(batch.column(1))
            ids, n = batch.column(0), np.diff(offsets) // 4
            start = batch.column(2).to_numpy()
            first, last = start // length, (start + n - 1) // length
            counts = np.where(n > 0, last - first + 1, 0)
            row = np.repeat(np.arange(len(n)), counts)
            sequence = W.ranges(first, counts)
            begin = np.maximum(sequence * length, start[row])
            size = np.minimum((sequence + 1) * length, (start + n)[row]) - begin
            place = offsets[row] + 4 * (begin - start[row])
            view = memoryview(np.ascontiguousarray(data))
            crc = [zlib.crc32(view[a : a + 4 * k]) for a, k in zip(place.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(begin - start[row]), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    ``tokens``: what ``tokenised`` gave, written down, so that partition numbers and
    offsets stay as they are.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each input partition: the only thing that a single task sees.
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(small(written(base, "bases")), "part").select("doc_id", "ids", (F.col("base") + F.col("local_start")).alias("at"))
    return placed.transform(mapped, _pieces(length), PIECE_SCHEMA)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Both passes: each document's pieces, their sequence and their offset in it."""
    return packed(Written(tokenised(docs, doc_id, text, vocabulary, end_id), "tokens").df, length)


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The sequences themselves: ids in order, by sequence_id (at most ``length`` each)."""
    cut = F.substring  # bytes of a binary column
    ids = tokens.select(F.col("doc_id"), "ids", F.col("n_tokens").alias("doc_tokens"))
    rows = pieces.join(ids, ["doc_id", "doc_tokens"]).withColumn("piece", cut("ids", F.col("start").cast("int") * 4 + 1, F.col("length").cast("int") * 4))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "piece")))
    return rows.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["piece"])).alias("ids"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
