"""Language identification, word first.

A word is a run of characters without ASCII white space, of which only the letters count, in
lower case.  A known word is scored by its log frequency in each language.  An unknown word
backs off to character n-grams: it is cut, from the left, into the longest known n-grams
(``MAX_GRAM`` characters down to one), whose log frequencies are averaged, with a constant
taken off for each step down.  A text's score for a language is the mean over its words plus
the language's log prior.

Scores of languages are only relative to one another, so there is an absolute measure
beside them, the *fit*: the share of the text that is made of the best language's own words
or, in unknown words, of its n-grams of ``LONG`` characters or more.  What a language's own
texts reach is learnt from the training rows; ``accepted`` rejects texts that fall far short
of it, such as those in languages that nobody has labelled.

Training reads only labelled rows and learns every label.  It is bounded by ``PER_LANGUAGE``
documents for each language (the smallest hashes of doc_id, so the same rows however the
table is stored), and the model by the ``WORDS`` most frequent words and ``GRAMS`` n-grams of
each language, ``ENTRIES`` altogether (ties by code points).  Prediction reads every whole
text.

Edge cases: a null text or one without any letter is ``und`` with score 0; rows without a
language are never learnt from but predicted; with no labelled row at all everything is
``und``; texts that score alike for several languages get the first by name; repeated rows
are learnt from and predicted as often as they occur; columns other than the id, the text
and the language are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import table, written
from .workers import mapped

PER_LANGUAGE = 2000
WORDS = 20_000
GRAMS = 20_000
#: Words and n-grams of all languages together.
ENTRIES = 2_000_000
MAX_GRAM = 4
#: Characters from which an n-gram counts for the fit.
LONG = 3
#: Log probability taken off for each character by which an n-gram falls short.
BACKOFF = 0.5
UNKNOWN = "und"
#: Share of the language's usual fit that an accepted text needs, and what is allowed to
#: texts of few words (over the root of their number).
LEAST_FIT, ALLOWANCE = 0.5, 0.5
#: What the best language's score must be above that of a draw, as a share of the rest.
LEAST_MARGIN = 0.02
#: Text bytes whose distinct words are looked up at once.
LOOKED_UP = 3 << 20

_NO_LETTER = re.compile(r"[^\w\n]|[\d_]")


def normalised(words: list[bytes]) -> list[str]:
    """The letters of each word in lower case; empty if it has none."""
    if not words:
        return []
    text = b"\n".join(words).decode(errors="replace").lower()
    out = _NO_LETTER.sub("", text).split("\n")
    if len(out) != len(words):  # a word's lower case can't hold a line end, but its bytes could
        out = ["".join(c for c in w.decode(errors="replace").lower() if c.isalpha()) for w in words]
    return [w if not w or w.isalpha() else "".join(c for c in w if c.isalpha()) for w in out]


def _spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded words back to back, and where each word begins."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "replace"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def _gram_codes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of the n-gram at each place but the last n - 1 (up to three characters: exact)."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        part = points[k : k + count].astype(np.uint64) + np.uint64(1)
        out = W.mixed(out * np.uint64(0x9E3779B97F4A7C15) + part) if k == MAX_GRAM - 1 else (out << np.uint64(20)) ^ part
    return out


class Units:
    """Words or n-grams of all languages: for each its languages, and their scores above the floor."""

    def __init__(self, keys, ends: np.ndarray, language: np.ndarray, score: np.ndarray, floor: np.ndarray):
        self.keys, self.ends, self.language, self.score, self.floor = keys, ends, language, score, floor

    def entries(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the units' entries back to back, and how many each has."""
        begins = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else np.zeros(0, np.int64)
        counts = self.ends[unit] - begins[unit]
        return W.ranges(begins[unit], counts), counts


class Model:
    def __init__(self, languages: list[str], priors: np.ndarray, words: Units, grams: Units, usual: np.ndarray):
        self.languages, self.priors, self.words, self.grams, self.usual = languages, priors, words, grams, usual

    def _parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unknown words cut into n-grams: word, unit (-1: none) and length of each part."""
        points, begins = _spelt(words)
        own = np.full(len(points), -1, np.int64)
        size = np.ones(len(points), np.int64)
        last = np.repeat(begins[1:], np.diff(begins))
        for n in range(1, MAX_GRAM + 1):
            codes = _gram_codes(points, n)
            if not len(codes) or not len(self.grams.keys):
                continue
            place = np.minimum(np.searchsorted(self.grams.keys, codes), len(self.grams.keys) - 1)
            hit = np.flatnonzero((self.grams.keys[place] == codes) & (np.arange(len(codes)) + n <= last[: len(codes)]))
            own[hit], size[hit] = place[hit], n
        word, unit, length = [], [], []
        at, live = begins[:-1].copy(), np.arange(len(words))
        while len(live):
            here = at[live]
            word.append(live)
            unit.append(own[here])
            length.append(size[here])
            at[live] += size[here]
            live = live[at[live] < begins[live + 1]]
        none = np.zeros(0, np.int64)
        return (np.concatenate(x) if x else none for x in (word, unit, length))

    def entries(self, words: list[str]):
        """How many floors each word takes, and its entries: word, language, score, fit."""
        known = pc.index_in(pa.array(words, pa.string()), value_set=self.words.keys).to_numpy(zero_copy_only=False) if len(self.words.keys) else np.full(len(words), np.nan)
        lettered = np.array([bool(w) for w in words], bool)
        is_known = ~np.isnan(known.astype(np.float64))
        hit = np.flatnonzero(is_known)
        at, counts = self.words.entries(known[hit].astype(np.int64))
        out = [(np.repeat(hit, counts), self.words.language[at], self.words.score[at], np.ones(len(at)))]
        rest = np.flatnonzero(lettered & ~is_known)
        if len(rest):
            word, unit, length = self._parts([words[k] for k in rest.tolist()])
            parts = np.bincount(word, minlength=len(rest))
            chars = np.bincount(word, weights=length, minlength=len(rest))
            some = np.flatnonzero(unit >= 0)
            at, counts = self.grams.entries(unit[some])
            owner = np.repeat(word[some], counts)
            covers = np.where(length[some] >= LONG, length[some] / chars[word[some]], 0.0)
            out.append((rest[owner], self.grams.language[at], self.grams.score[at] / parts[owner], np.repeat(covers, counts)))
        return lettered, is_known, [np.concatenate(x) for x in zip(*out, strict=True)]

    def judged(self, text: W.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row: the best language (its number, or how many there are), the score, the
        fit to that language, and how many words have letters."""
        k, rows = len(self.languages), len(text.offsets) - 1
        best, score, fit, n = np.full(rows, k), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        w = W.split(text, W.SPACE_WORD)
        if not k or not len(w):
            return best, score, fit, n
        code, distinct = w.coded()
        lettered, known, (word, language, value, cover) = self.entries(normalised(distinct.to_pylist()))
        row = np.repeat(np.arange(rows), np.diff(w.rows))
        pair, times = np.unique(row * len(distinct) + code, return_counts=True)
        pair_row, pair_word = pair // len(distinct), pair % len(distinct)
        n = np.bincount(pair_row, weights=times * lettered[pair_word], minlength=rows)
        n_known = np.bincount(pair_row, weights=times * known[pair_word], minlength=rows)
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(distinct)))
        counts = np.diff(np.concatenate(([0], ends)))[pair_word]
        at = order[W.ranges(ends[pair_word] - counts, counts)]
        cell = np.repeat(pair_row, counts) * k + language[at]
        many = np.repeat(times, counts)
        sums = np.bincount(cell, weights=many * value[at], minlength=rows * k).reshape(rows, k)
        covered = np.bincount(cell, weights=many * cover[at], minlength=rows * k).reshape(rows, k)
        some = np.flatnonzero(n > 0.5)
        z = sums[some] + np.outer(n_known[some], self.words.floor) + np.outer((n - n_known)[some], self.grams.floor) + self.priors
        z = (z - z.max(axis=1, keepdims=True)) / np.sqrt(n[some, None])
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best[some] = np.argmax(z, axis=1)
        score[some] = p.max(axis=1)
        fit[some] = covered[some, best[some]] / n[some]
        return best, score, fit, n


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and n-grams by language, added up within each batch."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    names = ["lang", "kind", "unit", "n"]
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for text in W.chunks(batch.column(1)):
            w = W.split(text, W.SPACE_WORD)
            code, distinct = w.coded()
            words = normalised(distinct.to_pylist())
            own = np.array([lang[text.first + r] for r in range(len(text.offsets) - 1)], object)
            row = np.repeat(np.arange(len(own)), np.diff(w.rows))
            for name in sorted(set(own.tolist())):
                counts: dict[str, int] = {}
                grams: dict[str, int] = {}
                times = np.bincount(code[own[row] == name], minlength=len(words))
                for k in np.flatnonzero(times).tolist():
                    if words[k]:
                        counts[words[k]] = counts.get(words[k], 0) + int(times[k])
                for word, n in counts.items():
                    padded = f"^{word}$"
                    for size in range(1, MAX_GRAM + 1):
                        for at in range(len(padded) - size + 1):
                            g = padded[at : at + size]
                            grams[g] = grams.get(g, 0) + n
                rows = [(name, "w", u, n) for u, n in counts.items()] + [(name, "g", u, n) for u, n in grams.items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _usual(shared):
    """Sum of the fit of training texts to their own language, and their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        sums: dict[str, list[float]] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for text in W.chunks(batch.column(1), LOOKED_UP):
                best, _, fit, n = model.judged(text)
                for r in np.flatnonzero(n > 0.5).tolist():
                    name = lang[text.first + r]
                    if model.languages[best[r]] == name:
                        own = sums.setdefault(name, [0.0, 0.0])
                        own[0] += float(fit[r])
                        own[1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.float64()), pa.array([x[1] for x in sums.values()], pa.float64())], ["lang", "fit", "n"])

    return run


def _units(found: pa.Table, languages: list[str], kind: str) -> Units:
    own = found.filter(pc.equal(found["kind"], kind))
    index = pc.index_in(own["lang"], value_set=pa.array(languages)).to_numpy().astype(np.int64)
    count, total = own["n"].to_numpy().astype(np.float64), own["total"].to_numpy().astype(np.float64)
    sums = np.zeros(len(languages))
    sums[index] = total
    floor = np.log(0.5 / (sums + 1))
    score = np.log((count + 0.5) / (total + 1)) - floor[index]
    if kind == "w":
        keys = pc.unique(own["unit"]).sort() if len(own) else pa.array([], pa.string())
        unit = pc.index_in(own["unit"], value_set=keys).to_numpy().astype(np.int64) if len(own) else np.zeros(0, np.int64)
    else:
        codes = np.array([_gram_codes(np.frombuffer(u.encode("utf-32-le", "replace"), np.uint32), len(u))[0] for u in own["unit"].to_pylist()], np.uint64)
        keys, unit = np.unique(codes, return_inverse=True)
    order = np.lexsort((index, unit))
    ends = np.cumsum(np.bincount(unit, minlength=len(keys))) if len(keys) else np.zeros(0, np.int64)
    return Units(keys, ends.astype(np.int64), index[order].astype(np.int32), score[order].astype(np.float32), floor)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model of all labels of the labelled rows."""
    spark = docs.sparkSession
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        none = Units(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
        return Model([], np.zeros(0), none, Units(np.zeros(0, np.uint64), none.ends, none.language, none.score, none.floor), np.zeros(0))
    count = {r["lang"]: r["count"] for r in sizes}
    languages = sorted(count)
    total = sum(count.values())
    each = max(1, ENTRIES // (2 * len(languages)))
    # The smallest hashes of each language, by a bound on the hash that its size gives.
    share = F.broadcast(spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in count.items()], "lang string, share double"))
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = written(labelled.join(share, "lang").filter(hashed <= F.col("share")).select("lang", "text"), "lang-sample")
    sums = sample.transform(mapped, _counted, "lang string, kind string, unit string, n bigint").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    by_kind = Window.partitionBy("lang", "kind")
    ranked = sums.withColumn("total", F.sum("n").over(by_kind)).withColumn("rank", F.row_number().over(by_kind.orderBy(F.desc("n"), "unit")))
    found = ranked.filter(F.col("rank") <= F.when(F.col("kind") == "w", min(words, each)).otherwise(min(grams, each))).drop("rank").toArrow()  # at most ENTRIES rows
    priors = np.array([math.log(count[k] / total) for k in languages])
    model = Model(languages, priors, _units(found, languages, "w"), _units(found, languages, "g"), np.ones(len(languages)))
    shared = spark.sparkContext.broadcast(model)
    fits = sample.transform(mapped, _usual(shared), "lang string, fit double, n double").groupBy("lang").agg((F.sum("fit") / F.sum("n")).alias("usual")).collect()
    shared.destroy()
    usual = {r["lang"]: r["usual"] for r in fits}
    model.usual = np.array([usual.get(k) or 0.0 for k in languages])
    return model


def _predicted(shared, at: int, lang_pred: str, score_name: str, accepts: str):
    """``at``: the column that holds the text; all columns are handed on, with three behind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], object)
        usual = np.append(model.usual, 0.0)
        for batch in batches:
            for text in W.chunks(batch.column(at), LOOKED_UP):
                best, score, fit, n = model.judged(text)
                margin = (score - 1 / k) / (1 - 1 / k) if k > 1 else np.ones(len(score))
                fits = (n > 0.5) & (fit + ALLOWANCE / np.sqrt(np.maximum(n, 1)) >= LEAST_FIT * usual[best]) & (margin >= LEAST_MARGIN)
                own = batch.slice(text.first, len(best))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(fits)], [*batch.schema.names, lang_pred, score_name, accepts])

    return run


def identified(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", accepts: str = "accepts") -> DataFrame:
    """All columns of ``docs``, with the language and the score (0 to 1) of every whole text,
    and whether the text fits that language."""
    # At most ENTRIES numbers, whatever the table's size.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(accepts, T.BooleanType())])
    return docs.transform(mapped, _predicted(shared, docs.columns.index(text), lang_pred, score, accepts), columns)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepts of every text."""
    return identified(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), model).drop("text")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is in a known language, columns as they were.

    Rejected are texts without a letter, those that fit their best language much less than
    its own texts do, and those that speak for no language more than for the others.  A model
    that has learnt nothing rejects only texts without a letter.
    """
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    return identified(docs, model, text, "__lang_pred", "__score", "__accepts").filter("__accepts").drop("__lang_pred", "__score", "__accepts")


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
