"""License scans by ordered signature rules.

Rules are regular expressions, written by hand (``license_rules``), over a text's words
(lower-cased, joined by one space).  A rule runs only on texts that hold one of its keywords.
Where detections overlap, priority decides: one whose interval lies inside that of a
detection of a higher priority, or of the same priority and greater length, is suppressed.
The base phrases have the highest priority and are never suppressed.  The work grows with a
text's length and, for its detections, as n log n.

Edge cases: a null or empty text has no words and no label, score 0; a repeated row is
scanned again; columns other than the id and the text are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_rules
from . import words as W
from .store import table
from .workers import mapped

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label: string, rule: string, first: bigint, words: bigint>>"


class Rule(NamedTuple):
    name: str
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    priority: int
    score: float


# Phrases that are always reported, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

BASE_PRIORITY, BASE_SCORE = 100, 1.0


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; every pattern begins and ends at a word."""

    def rule(name, label, pattern, keywords, priority, score):
        return Rule(name, label, re.compile(f"(?<= )(?:{pattern})(?= )".encode()), tuple(k.encode() for k in keywords), priority, score)

    made = [rule(f"base-{label}", label, phrase, (phrase,), BASE_PRIORITY, BASE_SCORE) for phrase, label in BASE]
    made += [rule(f"{priority}-{k}", label, pattern, keywords, priority, score) for k, (label, keywords, pattern, priority, score) in enumerate(license_rules.written())]
    return tuple(sorted(made, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def keywords() -> tuple[bytes, ...]:
    return tuple(sorted({k for r in rules() for k in r.keywords}))


def _suppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Those that lie in none of a higher priority, or of the same priority and longer.

    ``found`` goes from the highest priority to the lowest.  A tree over the starts holds, for
    each prefix of them, the greatest end of what stays so far.
    """
    starts = sorted({a for _, a, _, _ in found})
    reach = [-1] * (len(starts) + 1)
    stay = []
    for _, a, b, r in found:
        k = bisect_right(starts, a)
        furthest, at = -1, k
        while at:
            furthest = max(furthest, reach[at])
            at &= at - 1
        if r.priority < BASE_PRIORITY and furthest >= b:
            continue
        stay.append((a, b, r))
        while k < len(reach):
            reach[k] = max(reach[k], b)
            k += k & -k
    return stay


def detections(words: bytes, some: Iterable[bytes] | None = None) -> list[tuple[int, int, Rule]]:
    """(begin, end, rule) of what stays; ``words``: joined by one space, and one at either end.

    ``some``: the keywords that can be there at all, if that is known.
    """
    present = {k for k in (keywords() if some is None else some) if k in words}
    if not present:
        return []
    found = [(k, m.start(), m.end(), r) for k, r in enumerate(rules()) if not present.isdisjoint(r.keywords) for m in r.pattern.finditer(words)]
    # Higher priority first, then longer, then earlier.
    found.sort(key=lambda x: (-x[3].priority, x[1] - x[2], x[1], x[0]))
    return sorted(_suppressed(found), key=lambda x: (x[0], x[1], x[2].name))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for batch in batches:
        for text in W.chunks(batch.column(1)):
            w = W.split(text, W.ALNUM_WORD, lower=True)
            whole = W.joined(w)
            some = [k for k in keywords() if k in whole]
            at = w.offsets[w.rows] + w.rows  # where each row's first word begins
            out = []
            for r, n in enumerate((w.rows[1:] - w.rows[:-1]).tolist()):
                own = b" " + whole[at[r] : at[r + 1]] if n else b""
                found = detections(own, some) if n else []
                if not found:
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                blanks = np.flatnonzero(np.frombuffer(own, np.uint8) == 0x20)
                first = np.searchsorted(blanks, [a for a, _, _ in found], side="left") - 1
                last = np.searchsorted(blanks, [b for _, b, _ in found], side="left") - 1
                base = [(p, x[2].label) for p, x in zip(first.tolist(), found, strict=True) if x[2].priority == BASE_PRIORITY]
                told = [{"label": x[2].label, "rule": x[2].name, "first": p, "words": q - p + 1} for p, q, x in zip(first.tolist(), last.tolist(), found, strict=True)]
                out.append((n, len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted({x[2].label for x in found})), max(x[2].score for x in found), told))
            cols = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first, len(out)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each whole text says of its licence, with every detection that stays."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).transform(mapped, _scan, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
