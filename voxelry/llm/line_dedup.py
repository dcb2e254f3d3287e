"""Line dedup with a log-template tree.

Everything here is built of DataFrame functions.

A line goes down a tree of fixed depth: by its number of tokens (parted by any white
space), then by its ``DEPTH`` leading tokens.  Short tokens with a digit are variable
fields from the start; of tokens that are long or not ASCII only the digits are.  A line of
which less than ``CONSTANT`` of the tokens have a letter left stays as it is.  The lines of
a leaf that agree in all other tokens have one template.  In a leaf where lines recur but
differ, fields with words are found by how often each token stands at its place of the leaf:
for every power of ``LEVEL``, tokens that are at least so frequent are constant and the
others are fields.  A line has one template for each power that tells its tokens apart, if at
least ``SIMILAR`` of its tokens are constant there; so a leaf can have any number of
templates, frequent and rare ones, and the work is a fixed number of passes over its lines.

A template that recurs in at least ``MIN_FAMILIES`` *families* of documents is boilerplate,
and its lines are dropped from all documents, however many copies one family has.  A family
is a class of near copies: documents with the same leaves are one, and documents that share
a leaf are linked if at least ``NEAR`` of their words are the same (by a sketch of the
``SKETCH`` smallest hashes).  Lines that recur only because whole documents were copied
stay, and are left to document dedup.

Counts are summed before they are shuffled, at most once for each template and family;
whole lines are only moved where their leaf recurs and its lines differ.  The list of
templates is broadcast up to a fixed number of rows and joined by a shuffle beyond.

Edge cases: a null text stays null and has no lines; blank lines are never dropped nor
counted; a document may lose all of its lines, then its text is empty; rows of one doc_id
and text are one document; a row without a doc_id counts but loses nothing; all columns
but the id and the text are handed on as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import small, table, written

DEPTH = 3
MIN_FAMILIES = 5
SIMILAR = 0.6
#: Steps between the frequencies from which a token counts as constant.
LEVEL = 8
#: Share of tokens with a letter that a line with variable fields needs.
CONSTANT = 0.5
#: Words that documents must share to be near copies, and hashes of them that are compared.
NEAR = 0.85
SKETCH = 64

_SPACE = r"[\s\p{Z}&&[^\n]]+"
#: White space that is no single blank.
_ODD_SPACE = r"[\s\p{Z}&&[^\n ]]| [\s\p{Z}&&[^\n]]"
_VARIABLE = r"(?<![^ ])(?=[!-~]{1,40}(?: |$))[^ 0-9]*[0-9][^ ]*"


def split_lines(text: Column) -> Column:
    """The lines, with one space for each run of white space."""
    return F.split(F.when(text.rlike(_ODD_SPACE), F.regexp_replace(text, _SPACE, " ")).otherwise(text), "\n", -1)


def masked(line: Column) -> Column:
    """The line's tokens, variable ones as one sign; the line itself if too few are constant."""

    def chosen(x: Column) -> Column:
        tokens = F.split(x["new"], " ", -1)
        return F.when(F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}"))) >= CONSTANT * F.size(tokens), x["new"]).otherwise(x["own"])

    def replaced(own: Column) -> Column:
        new = F.regexp_replace(F.regexp_replace(own, _VARIABLE, "<*>"), "[0-9]+", "<*>")
        return F.when(~own.rlike("[0-9]"), own).otherwise(let(F.struct(own.alias("own"), new.alias("new")), chosen))

    return let(F.trim(line), replaced)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def leaf_of(line: Column) -> Column:
    """Hash of the number of tokens and the leading ones, of a masked line."""
    count = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(count, F.substring_index(line, " ", DEPTH))


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, key, print (of all leaves) and, by line, its template and leaf (null: blank)."""
    lines = F.transform(split_lines(F.col("text")), masked)
    both = F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x, F.lit(1)).alias("template"), leaf_of(x).alias("leaf"))))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "key", both.alias("lines"))
    return rows.select("doc_id", "key", F.xxhash64(F.array_sort(_distinct("leaf"))).alias("print"), "lines")


def _distinct(name: str) -> Column:
    return F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: x[name]))


def _recurring(pairs: DataFrame, unit: str, by: str, least: int) -> DataFrame:
    """Units of ``pairs`` that are with at least so many different ``by``."""
    return pairs.groupBy(unit, by).agg(F.lit(1).alias("n")).groupBy(unit).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(unit)


def _families(docs: DataFrame, lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """print, family: of the prints that are linked with others."""
    held = lines.select("print", F.explode(_distinct("leaf")).alias("leaf")).groupBy("leaf", "print").agg(F.count("*").alias("n"))
    # Only documents with a leaf that recurs are asked for their family.
    some = small(written(held.join(leaves, "leaf", "left_semi").select("print").distinct(), "prints"))
    held = written(held.join(some, "print", "left_semi"), "held")
    # In each leaf, everyone is compared with the print of most documents and with the least one.
    hubs = small(written(held.groupBy("leaf").agg(F.max(F.struct("n", "print"))["print"].alias("x"), F.min("print").alias("y"), F.count("*").alias("all")).filter("all > 1").select("leaf", F.explode(F.array_distinct(F.array("x", "y"))).alias("hub")), "hubs"))
    pairs = written(held.join(hubs, "leaf").filter("print <> hub").select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct(), "pairs")
    words = F.filter(F.split("text", r"[\s\p{Z}]+", -1), lambda x: x != "")
    sketch = F.slice(F.array_sort(F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))), 1, SKETCH)
    asked = lines.join(some, "print", "left_semi").groupBy("print").agg(F.min(F.struct("doc_id", "key")).alias("d"))
    asked = small(written(asked.select("print", F.col("d.doc_id").alias("doc_id"), F.col("d.key").alias("key")), "asked"))
    same = F.col("text").isNotNull() & docs["doc_id"].eqNullSafe(asked["doc_id"]) & (docs["key"] == asked["key"])
    sketches = written(docs.join(asked, same).select("print", sketch.alias("sketch")).groupBy("print").agg(F.min("sketch").alias("sketch")), "sketches")
    both = pairs.join(sketches.select(F.col("print").alias("a"), F.col("sketch").alias("s")), "a").join(sketches.select(F.col("print").alias("b"), F.col("sketch").alias("t")), "b")
    union = F.slice(F.array_sort(F.array_union("s", "t")), 1, SKETCH)
    alike = F.size(F.array_intersect(union, F.array_intersect("s", "t"))) >= NEAR * F.size(union)
    links = written(both.filter(alike).select("a", "b"), "links")
    return components(links, native=True).select(F.col("doc_id").alias("print"), F.col("component").alias("family"))


def _generalised(docs: DataFrame, lines: DataFrame, leaves: DataFrame, plain: DataFrame, families: int, similar: float) -> DataFrame:
    """doc_id, key and line number of lines under templates with generalised fields."""
    # Only leaves that hold lines of several templates have fields to generalise.
    own = lines.select(F.explode("lines").alias("line")).filter("line is not null").groupBy("line.leaf").agg(F.min("line.template").alias("a"), F.max("line.template").alias("b")).filter("a <> b").select("leaf")
    leaves = small(written(leaves.join(own, "leaf"), "open-leaves"))
    # Where these lines are; only they are read again.
    at = lines.select("doc_id", "key", "family", F.posexplode("lines").alias("at", "line")).filter("line is not null").select("doc_id", "key", "family", "at", "line.leaf", "line.template")
    places = at.join(leaves, "leaf").join(small(plain), "template", "left_anti").groupBy("doc_id", "key").agg(F.first("family").alias("family"), F.collect_set("at").alias("places"))
    places = small(written(places, "places"))
    same = docs["doc_id"].eqNullSafe(places["doc_id"]) & (docs["key"] == places["key"])
    asked = let(split_lines(F.col("text")), lambda x: F.transform("places", lambda i: F.struct(i.alias("at"), masked(F.get(x, i)).alias("line"))))
    some = docs.filter(F.col("text").isNotNull()).join(places, same).select(docs["doc_id"], docs["key"], "family", F.inline(asked))
    cells = F.transform(F.split("line", " ", -1), lambda t, i: F.xxhash64("leaf", i, t))
    some = some.select("doc_id", "key", "at", "family", "line", leaf_of(F.col("line")).alias("leaf")).select("doc_id", "key", "at", "leaf", cells.alias("cells"), "family", F.monotonically_increasing_id().alias("line"))
    open_ = written(some, "open")
    # How often each token stands at its place of its leaf, as a power of LEVEL.
    token = open_.select("line", F.posexplode("cells").alias("place", "cell"))
    level = F.floor(F.log(F.col("n") / families) / math.log(LEVEL) + 1e-9).cast("int")
    frequent = written(token.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= families).select("cell", level.alias("level")), "frequent")
    told = token.join(small(frequent), "cell").groupBy("line").agg(F.collect_list(F.struct("place", "level", "cell")).alias("told"))
    told = written(told.withColumn("told", F.array_sort("told")), "told")
    # One template for each power that parts a line's tokens: what is rarer is a field.
    at = lambda x: F.filter("told", lambda t: t["level"] >= x)
    each = F.transform(F.array_distinct(F.transform("told", lambda t: t["level"])), lambda x: F.struct(F.size(at(x)).alias("constant"), F.xxhash64("leaf", F.size("cells"), F.transform(at(x), lambda t: t["cell"])).alias("unit")))
    rows = open_.join(told, "line").select("doc_id", "key", "at", "family", F.explode(F.filter(each, lambda t: t["constant"] >= similar * F.size("cells"))).alias("t")).select("doc_id", "key", "at", "family", "t.unit")
    rows = written(rows, "units")
    return rows.join(small(written(_recurring(rows, "unit", "family", families), "found")), "unit", "left_semi").select("doc_id", "key", "at")


def boilerplate(docs: DataFrame, min_families: int = MIN_FAMILIES, similar: float = SIMILAR) -> DataFrame:
    """doc_id, key and the numbers of the lines that recur; ``docs``: doc_id, key, text."""
    lines = written(parsed(docs), "parsed")
    leaves = written(_recurring(lines.select("print", F.explode(_distinct("leaf")).alias("leaf")), "leaf", "print", min_families), "leaves")
    lines = lines.join(small(written(_families(docs, lines, leaves), "families")), "print", "left").withColumn("family", F.coalesce("family", "print"))
    units = lambda name: _recurring(lines.select("family", F.explode(_distinct(name)).alias(name)), name, "family", min_families)
    plain = written(units("template"), "templates")
    at = lines.select("doc_id", "key", F.posexplode("lines").alias("at", "line")).filter("line is not null").select("doc_id", "key", "at", F.col("line.template").alias("template"))
    hits = at.join(small(plain), "template").select("doc_id", "key", "at").union(_generalised(docs, lines, units("leaf"), plain, min_families, similar))
    return hits.groupBy("doc_id", "key").agg(F.collect_set("at").alias("dropped"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """All columns and rows, the text without recurring lines, and with the columns
    __n_lines and __n_dropped."""
    key = F.xxhash64(F.col(text))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    hits = boilerplate(own, **limits).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("dropped").alias("__dropped"))
    rows = docs.join(hits, (F.col(doc_id).cast("bigint") == F.col("__id")) & (key == F.col("__key")), "left")
    lines = F.split(F.col(text), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    kept = let(F.struct(lines.alias("lines"), places.alias("places")), lambda x: F.transform(x["places"], lambda i: F.get(x["lines"], i)))
    new = F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(text) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("__n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("bigint").alias("__n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("text").alias("kept"))
