"""Secret scans: fixed patterns, and a battery of randomness tests.

Everything here is built of DataFrame functions.

The base kinds (``assign``, ``access``, ``hex``) are regular expressions.  The method adds
``random`` spans: a token that could be encoded random bytes gets its encoding inferred
from its characters (base 16, base 32 or base 64), and its symbols are tested for what
random bytes give: a chi-squared test that all symbols of the alphabet are used alike, a runs
test about the middle of the alphabet, and a test of the serial correlation at lag one.
Fisher's method combines the three to a score between 0 (certainly not random) and 1.

What is reported is controlled by the false-discovery rate: that a token is ordinary text
(names, paths, numbers) is the null hypothesis.  How ordinary text scores is measured on
``DECOYS`` made-up ordinary tokens for each encoding and class of lengths, put together by a
rule from common words and numbers; a token's p-value is the share of these decoys that
score at least as high.  The Benjamini-Hochberg procedure over all tokens of the whole table,
in each encoding and class of lengths by itself, then reports tokens such that about a share
``FALSE_DISCOVERY`` of them is ordinary, where they don't overlap a base span.  Where random
tokens are so rare that no cut can promise that, none is reported.  Tokens too short for the
tests to tell anything are not tested.  The procedure needs histograms of a fixed size only.

Edge cases: a null or empty text has no spans; overlapping base kinds are all kept; a
repeated row is scanned again; columns other than the id and the text are never read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, written

FALSE_DISCOVERY = 0.05
#: Made-up ordinary tokens for each encoding and class of lengths, and the greatest class.
DECOYS, MOST_SIZE = 4000, 7
#: Scores are counted by their negative logarithm in steps of 1 / STEPS, up to MOST.
STEPS, MOST = 16, 60

# The words that ordinary tokens are put together from.
DECOY_WORDS = """add all api app array async auth back base batch bean block body buffer build button byte cache call
check class clear client clone close code color column command common config context control copy count create
current custom data date default delete detail device display document domain download draw edit element empty
enable entity entry error event export factory field file filter final find first font form format frame from
function get global group guide handle has header height help home html image import index info init inner input
install item job key label last layer layout length level library line link list load local log login main make
manager map master max media member menu message method mode model module month name network new next node note
number object offset old open option order output page panel param parent parse part password path photo player
point post price print process product profile project property public query queue random range read record ref
refresh region register remove render report request reset resource response result return role root route row
run save scale scan scene screen script search section select send server service session set setting show size
sort source space start state static status step stop store stream string style submit summer sync system tab
table tag target task template test text theme thread time title token tool total track tree trigger type undo
unit update upload url user util valid value vector version video view wait web widget width window word work
write year zone""".split()

# Fixed patterns: kind, what is matched, the group whose length counts, and that length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 or more characters
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "random")

#: Encodings: name, characters in order of value, and the least length that is tested.
ENCODINGS = (
    ("base16", "0123456789abcdef", 24),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
)
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Matches that are added up together, and characters for which the spans in them are listed.
GROUP, REACH = 256, 4096
SPAN = "array<struct<start: bigint, end: bigint, kind: int>>"
CANDIDATE = "array<struct<start: bigint, end: bigint, encoding: int, size: int, bin: int>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, fits: Column | None = None) -> Column:
    """start, end and kind of each match, from the lengths of the matches and of what lies between.

    Places are added up in groups of ``GROUP`` matches, and the groups' lengths then: adding
    to one long array would copy it for each match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    ok = fits if fits is not None else F.transform(hits, lambda x: F.lit(True))
    rows = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("size"), ok.alias("ok"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a, x):
        begin = a["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["ok"], F.lit(False)), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def grouped(x):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / GROUP).cast("int")), lambda k: F.aggregate(F.slice(x, k * GROUP + 1, GROUP), empty, add))

    def placed(groups):
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("before"))
        before = F.aggregate(groups, none, lambda a, g: F.struct((a["at"] + g["at"]).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")), lambda a: a["before"])
        return F.flatten(F.zip_with(groups, before, lambda g, o: F.transform(g["out"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["kind"].alias("kind")))))

    found = _let(_let(rows, grouped), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind, by start; a match that is too short is dropped."""
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= ASSIGN_LENGTH)
    return {"assign": _spans(text, ASSIGN, 0, long), "access": _spans(text, ACCESS, 1), "hex": _spans(text, HEX, 2)}


def erfc(x: Column) -> Column:
    """Complementary error function, to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    y = F.abs(x)
    t = 1 / (1 + 0.3275911 * y)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-y * y)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def _battery(values: Column, size: int) -> Column:
    """The combined p-value of the three tests, for symbols 0 to ``size`` - 1."""
    names = ("n", "upper", "changes", "last", "first", "sum", "squares", "lag")
    none = F.struct(*[F.lit(-1.0 if k in ("last", "first") else 0.0).alias(k) for k in names])

    def add(a, v):
        v = v.cast("double")
        of = lambda c: F.when(c, 1.0).otherwise(0.0)
        later = a["last"] >= 0
        new = {"n": a["n"] + 1, "upper": a["upper"] + of(v * 2 >= size), "changes": a["changes"] + of(later & ((v * 2 >= size) != (a["last"] * 2 >= size))), "last": v, "first": F.when(later, a["first"]).otherwise(v), "sum": a["sum"] + v, "squares": a["squares"] + v * v, "lag": a["lag"] + F.when(later, a["last"] * v).otherwise(0.0)}
        return F.struct(*[new[k].alias(k) for k in names])

    # How often each symbol stands there, squared and added up: runs of equal symbols in order.
    run = F.struct(F.lit(-1).alias("symbol"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))
    longer = lambda a, v: F.struct(v.alias("symbol"), F.when(a["symbol"] == v, a["run"] + 1).otherwise(1.0).alias("run"), (a["squares"] + F.when(a["symbol"] == v, 2 * a["run"] + 1).otherwise(1.0)).alias("squares"))
    used = F.aggregate(F.array_sort(values), run, longer, lambda a: a["squares"])

    def tests(z):
        t, n = z["t"], z["t"]["n"]
        # Chi-squared over the alphabet; few symbols for each place, so with the exact mean and
        # variance, and a cube root that makes it nearly normal.
        mean = float(size - 1)
        shape = mean / 2 * n / F.greatest(n - 1, F.lit(1.0))
        chi = F.greatest(size / n * z["used"] - n, F.lit(0.0))
        p_chi = erfc((F.cbrt(chi / mean) - 1 + 1 / (9 * shape)) * F.sqrt(9 * shape / 2)) / 2
        # Runs below and above the middle.
        a, b = t["upper"], n - t["upper"]
        expected = 2 * a * b / n + 1
        spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = F.when(spread > 0, erfc(F.abs(t["changes"] + 1 - expected) / F.sqrt(2 * spread))).otherwise(1e-12)
        # Serial correlation at lag one.
        centre = t["sum"] / n
        power = t["squares"] - n * centre * centre
        lag = t["lag"] - centre * (2 * t["sum"] - t["first"] - t["last"]) + (n - 1) * centre * centre
        p_serial = F.when(power > 1e-9, erfc(F.abs(lag / power + 1 / n) * F.sqrt(n / 2))).otherwise(1e-12)
        return F.struct(*[F.greatest(p, F.lit(1e-12)).alias(k) for k, p in (("chi", p_chi), ("runs", p_runs), ("serial", p_serial))])

    def fisher(x):  # chi-squared with six degrees of freedom
        return F.exp(-x) * (1 + x + x * x / 2)

    p = _let(F.struct(F.aggregate(values, none, add).alias("t"), used.alias("used")), tests)
    return _let(_let(p, lambda q: -F.log(q["chi"]) - F.log(q["runs"]) - F.log(q["serial"])), fisher)


def _encoding(token: Column) -> Column:
    """Number of the encoding whose characters the token has, or null."""
    bare = F.regexp_replace(token, "=+$", "")
    base64 = bare.rlike("[0-9]") & bare.rlike("[a-z]") & bare.rlike("[A-Z]")
    return (
        F.when(bare.rlike("^[0-9a-fA-F]+$") & bare.rlike("[0-9]") & bare.rlike("[a-fA-F]") & ~(bare.rlike("[a-f]") & bare.rlike("[A-F]")), F.when(F.length(bare) >= ENCODINGS[0][2], 0))
        .when(bare.rlike("^[A-Z2-7]+$") & bare.rlike("[2-7]"), F.when(F.length(bare) >= ENCODINGS[1][2], 1))
        .when(base64, F.when(F.length(bare) >= ENCODINGS[2][2], 2))
    )


def _values(token: Column, encoding: Column) -> Column:
    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    chars = F.split(bare, "(?!^)(?=.)", -1)
    hexes = F.split(F.lower(bare), "(?!^)(?=.)", -1)
    of = lambda k, c: F.transform(c, lambda x: F.instr(F.lit(ENCODINGS[k][1]), x) - 1)
    return F.when(encoding == 0, of(0, hexes)).when(encoding == 1, of(1, chars)).otherwise(of(2, chars))


def _size(token: Column) -> Column:
    """The class of lengths: powers of two."""
    return F.least(F.floor(F.log2(F.length(token).cast("double"))), F.lit(MOST_SIZE)).cast("int")


def _bin(token: Column, encoding: Column) -> Column:
    """The class of the score: 0 for those that look most random."""
    values = _values(token, encoding)
    p = F.when(encoding == 0, _battery(values, 16)).when(encoding == 1, _battery(values, 32)).otherwise(_battery(values, 64))
    return F.greatest(_let(p, lambda x: F.least(F.floor(-F.log(F.greatest(x, F.lit(1e-30))) * STEPS), F.lit(MOST * STEPS)).cast("int")), F.lit(0))


def _candidates(text: Column, base: Column) -> Column:
    """Tokens apart from the base spans, with their encoding, class of length and p-value."""

    def tested(s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), _size(s["token"]).alias("size"), _bin(s["token"], s["encoding"]).alias("bin"))

    def found(z):
        # Base spans by stretch of the text, so that each token meets only those near it.
        near = lambda s: F.slice(z["by_stretch"], F.floor(s["start"] / REACH).cast("int") + 1, (F.floor((s["end"] - 1) / REACH) - F.floor(s["start"] / REACH) + 1).cast("int"))
        apart = F.filter(z["spans"], lambda s: ~F.exists(near(s), lambda g: F.exists(g, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
        told = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).alias("token")))
        coded = F.transform(told, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), _encoding(s["token"]).alias("encoding")))
        return F.transform(F.filter(coded, lambda s: s["encoding"].isNotNull()), tested)

    stretches = F.sequence(F.lit(0), F.floor(F.length(text) / REACH).cast("int"))
    listed = F.transform(stretches, lambda k: F.filter(base, lambda b: (b["start"] < (k + 1) * REACH) & (k * REACH < b["end"])))
    spans = _spans(text, TOKEN, 3)
    return F.when(text.rlike(TOKEN), _let(F.struct(spans.alias("spans"), listed.alias("by_stretch")), found)).otherwise(F.array().cast(CANDIDATE))


def decoys(each: int = DECOYS) -> list[str]:
    """Ordinary tokens of every encoding and class of lengths, always the same."""
    r = random.Random(20)
    out = []
    for size in range(4, MOST_SIZE + 1):
        low, high = max(20, 1 << size), (2 << size) - 1
        for k in range(each):
            n, words = r.randint(low, high), []
            while sum(map(len, words)) < n:
                w = r.choice(DECOY_WORDS)
                words.append(str(r.choice((1, 2, 3, 4, 8, 16, 24, 100, 2014, 2023, r.randint(0, 999)))) if words and r.random() < 0.15 else w.capitalize() if r.random() < 0.85 else w)
            mark = ("", "", "", "_", "-", "/")[k % 6]
            words[-1] = words[-1] + str(r.randint(0, 99))
            out.append(mark.join([words[0].lower(), *words[1:]])[-n:])
            out.append("".join(w.upper() for w in words if w.isalpha())[:n - 1] + r.choice("234567"))
            # What is written in base 16 without being random: counters, dates, repeated groups.
            unit = r.choice((f"{r.randint(0, 4095):03x}", f"{r.randint(0, 65535):04x}", f"{r.randint(0, 255):02x}00", "deadbeef", "cafe", "0123456789abcdef", "abcdef", f"20{r.randint(10, 29)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}a", "00ff", "ffffff00"))
            out.append((f"{r.randint(0, 255):02x}" + unit * n)[: max(n, 24)])
    return out


def _cutoffs(scanned: DataFrame, share: float) -> dict[tuple[int, int], int]:
    """For each stratum, up to which class of scores tokens are reported."""
    spark = scanned.sparkSession
    made = spark.createDataFrame([(t,) for t in decoys()], "token string").withColumn("encoding", _encoding(F.col("token"))).filter("encoding is not null")
    null = made.select("encoding", _size(F.col("token")).alias("size"), _bin(F.col("token"), F.col("encoding")).alias("bin"), F.lit(0).alias("own"))
    own = scanned.select(F.explode("candidates").alias("c")).select("c.encoding", "c.size", "c.bin", F.lit(1).alias("own"))
    counts = null.union(own).groupBy("encoding", "size", "bin").agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("null"))
    stratum = Window.partitionBy("encoding", "size")
    up = stratum.orderBy("bin")
    ranked = counts.select("encoding", "size", "bin", F.sum("own").over(up).alias("reported"), F.sum("null").over(up).alias("worse"), F.sum("own").over(stratum).alias("all"), F.sum("null").over(stratum).alias("decoys"))
    # The step-up procedure: the p-value of the last one reported against its rank.
    passed = ranked.filter((F.col("reported") > 0) & ((F.col("worse") + 1) / (F.col("decoys") + 1) <= share * F.col("reported") / F.col("all")))
    rows = passed.groupBy("encoding", "size").agg(F.max("bin").alias("bin")).collect()  # at most 12 rows
    return {(r["encoding"], r["size"]): r["bin"] for r in rows}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """All spans of each text: doc_id, base and random, both as start, end (code points,
    exclusive) and kind (a place in ``KINDS``), by start and then kind."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    base = F.concat(*base_spans(F.col("content")).values())
    both = _let(base, lambda b: F.struct(b.alias("base"), _candidates(F.col("content"), b).alias("candidates")))
    scanned = written(rows.select("doc_id", both.alias("found")), "secrets").select("doc_id", "found.base", "found.candidates")
    cut = _cutoffs(scanned, false_discovery)
    limit = F.create_map(*[F.lit(x) for (e, s), b in [((-1, 0), -1), *cut.items()] for x in (e * 16 + s, b)])
    reported = F.filter("candidates", lambda c: c["bin"] <= F.coalesce(F.try_element_at(limit, c["encoding"] * 16 + c["size"]), F.lit(-1)))
    random = F.transform(reported, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind")))
    return scanned.select("doc_id", "base", random.alias("random"))


def _told(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    by = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_told(by(F.col("base"))), 256).alias("base_sha256"),
        _told(by(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )
