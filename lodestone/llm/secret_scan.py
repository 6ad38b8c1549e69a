r"""Scans for secrets: patterns, and a battery of randomness tests; DataFrame functions only.

1. Patterns. Leftmost matches that do not overlap, of each kind: ``assign`` (a
   secret's name, a sign and a value of 12 characters or more), ``access`` (access
   keys of 18 or more) and ``hex`` (16 or more). A span is the whole match. Places
   are code points: a text is split at its matches, and lengths are summed.
2. Candidates: stretches of ``LEAST`` letters, digits and ``+/_-`` or more. The
   encoding is the smallest alphabet that holds them (``ENCODINGS``). A candidate
   passes the battery if none of three tests rejects that its symbols are drawn
   evenly and independently: chi-squared of the symbols, runs above and below the
   middle of the alphabet, and serial correlation, each at ``BATTERY`` by itself.
3. Short stretches of text pass such tests too, as these have no power there. So
   each candidate also gets a p-value for being text: how few pairs of equal
   symbols it has against ``Text.pairs``, and how many changes between lower case,
   capitals, digits and signs against ``Text.changes``, joined by Fisher's method.
   Per encoding and class of length (doubling), the Benjamini-Hochberg step over
   the corpus's distinct candidates gives the level below which at most ``RATE`` of
   those called random are expected to be text. Levels are quarter powers of two,
   so the tables it takes have a fixed size, and repeated candidates count once:
   a text that is copied often moves nothing.
4. Candidates beyond their level that pass the battery and lie in no span of a
   pattern are ``random`` spans.

Each row is judged where it is; texts are read once, and only spans and figures of
candidates are written. What is shuffled is one row a distinct candidate, by its
digest. The levels are one row an encoding and class.

Defined results: a null or empty text has no spans; repeated rows give repeated
rows, repeated ids too; very long texts are scanned whole, whatever their number of
matches; of spans that start together the order is that of ``KINDS``; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: The patterns and the least length of each kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS, ACCESS_LEAST = "AKIA[A-Z0-9]+", 18
HEX, HEX_LEAST = "[0-9a-f]+", 16
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % LEAST
BATTERY = 0.001
RATE = 0.01
#: Levels a halving of the p-value, and the last one.
STEPS, LAST = 4, 400
#: Of sums of lengths, so many are made one after the other.
BLOCK = 128

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@dataclass(frozen=True)
class Text:
    """What text of an encoding's letters is like: how often two symbols and three are equal, and how often neighbours change class."""

    pairs: float
    threes: float
    changes: float


#: (name, pattern, alphabet, text): letters of European languages; for ``hex`` numbers.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", Text(0.120, 0.020, 0.10)),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", Text(0.070, 0.0065, 0.10)),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, Text(0.070, 0.0065, 0.10)),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/", Text(0.055, 0.0050, 0.25)),
)


def upper_tail(z: Column) -> Column:
    """The part of a normal distribution above ``z``, by a rational approximation."""
    x = F.least(F.abs(z), F.lit(26.0))
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def starts_of(steps: Column) -> Column:
    """Of each of an array's lengths, the sum of those before it; in blocks, so that long arrays take little more than their size."""
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def running(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.struct(first.alias("at"), none.alias("out")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    block = lambda b: F.slice(steps, (b * BLOCK + 1).cast("int"), BLOCK)
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    heads = running(F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda a, s: a + s)), zero)
    return F.when(F.size(steps) > 0, F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), heads.alias("at")), lambda x: running(block(x["b"]), x["at"])))).otherwise(none)


def with_spans(rows: DataFrame, name: str, pattern: str, text: str) -> DataFrame:
    """Add ``name``: array of (start, end, found) of the pattern's matches."""
    size = lambda x: F.char_length(x).cast("bigint")
    rows = rows.withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = F.size("_hits") > 0
    rows = rows.withColumn("_gaps", F.when(found, F.transform(F.split(text, pattern, -1), size)))
    rows = rows.withColumn("_steps", F.when(found, F.transform("_hits", lambda h, i: F.get("_gaps", i) + size(h))))
    rows = rows.withColumn("_starts", F.when(found, starts_of(F.col("_steps"))))
    span = lambda h, i: F.struct((F.get("_starts", i) + F.get("_gaps", i)).alias("start"), (F.get("_starts", i) + F.get("_steps", i)).alias("end"), h.alias("found"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return rows.withColumn(name, F.when(found, F.transform("_hits", span)).otherwise(none)).drop("_hits", "_gaps", "_steps", "_starts")


def _encoding(found: Column) -> Column:
    """The name of the smallest alphabet that holds a candidate."""
    return F.coalesce(*[F.when(found.rlike(pattern), F.lit(name)) for name, pattern, _, _ in ENCODINGS])


def _by_encoding(encoding: Column, value) -> Column:
    """``value(alphabet, text)`` of a candidate's encoding."""
    out = value(*ENCODINGS[-1][2:])
    for name, _, alphabet, like in reversed(ENCODINGS[:-1]):
        out = F.when(encoding == name, value(alphabet, like)).otherwise(out)
    return out


def _runs(marks: Column, symbols: str) -> Column:
    """The number of stretches of equal marks."""
    return F.char_length(F.regexp_replace(marks, "|".join(f"{s}+" for s in symbols), "x"))


def figures(rows: DataFrame, name: str, new: str) -> DataFrame:
    """Add ``new``: of each candidate span its place, digest, encoding, length, level, and whether it passes the battery."""
    own_case = lambda t, e: F.when(e.isin("hex", "base36"), F.lower(t)).otherwise(F.translate(t, "-_", "+/"))
    rows = rows.withColumn("_a", F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), _encoding(s["found"]).alias("encoding"))))
    rows = rows.withColumn("_b", F.transform("_a", lambda s: F.struct(s["start"], s["end"], s["found"], s["encoding"], own_case(s["found"], s["encoding"]).alias("text"), _by_encoding(s["encoding"], lambda a, _: F.lit(a)).alias("alphabet"))))

    classes = lambda t: F.translate(t, _LOWER + _UPPER + _DIGITS + "+/-_", "l" * 26 + "u" * 26 + "d" * 10 + "s" * 4)
    halves = lambda s: _by_encoding(s["encoding"], lambda a, _: F.translate(s["text"], a, "0" * (len(a) // 2) + "1" * (len(a) // 2)))
    values = lambda s: F.transform(F.split(s["text"], ""), lambda c: F.instr(s["alphabet"], c).cast("double"))
    counts = lambda s: F.aggregate(F.array_distinct(F.split(s["text"], "")), F.lit(0.0), lambda a, c: a + F.pow(F.char_length(s["text"]) - F.char_length(F.replace(s["text"], c, F.lit(""))), F.lit(2.0)))
    rows = rows.withColumn(
        "_c",
        F.transform(
            "_b",
            lambda s: F.struct(
                s["start"],
                s["end"],
                F.md5(s["found"]).alias("digest"),
                s["encoding"],
                F.char_length(s["text"]).cast("double").alias("n"),
                F.char_length(s["alphabet"]).cast("double").alias("k"),
                counts(s).alias("squares"),
                (_runs(classes(s["found"]), "luds") - 1).cast("double").alias("changes"),
                halves(s).alias("halves"),
                values(s).alias("values"),
            ),
        ),
    )
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn(
        "_d",
        F.transform(
            "_c",
            lambda s: F.struct(
                *[s[c] for c in ("start", "end", "digest", "encoding", "n", "k", "squares", "changes")],
                F.char_length(F.replace(s["halves"], F.lit("0"), F.lit(""))).cast("double").alias("high"),
                _runs(s["halves"], "01").cast("double").alias("runs"),
                total(s["values"]).alias("sum"),
                F.aggregate(s["values"], F.lit(0.0), lambda a, x: a + x * x).alias("sum2"),
                total(F.zip_with(s["values"], F.slice(s["values"], 2, F.greatest(F.size(s["values"]) - 1, F.lit(0))), lambda x, y: x * F.coalesce(y, F.lit(0.0)))).alias("lagged"),
                (F.get(s["values"], F.lit(0)) + F.get(s["values"], F.size(s["values"]) - 1)).alias("ends"),
            ),
        ),
    )
    return rows.withColumn(new, F.transform("_d", _judged)).drop("_a", "_b", "_c", "_d")


def _judged(s: Column) -> Column:
    n, k = s["n"], s["k"]
    # Chi-squared: its mean is k - 1, its variance 2 (k - 1) (n - 1) / n.
    chi = k / n * s["squares"] - n
    p_chi = upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    # Runs, given how many symbols are in the upper half.
    both = 2 * s["high"] * (n - s["high"])
    spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
    p_runs = F.when((both > n), 2 * upper_tail(F.abs(s["runs"] - both / n - 1) / spread)).otherwise(F.lit(0.0))
    # The correlation of neighbours; its mean is -1/n, its variance about 1/n.
    mean = s["sum"] / n
    about = s["sum2"] - n * mean * mean
    with_next = s["lagged"] - mean * (2 * s["sum"] - s["ends"]) + (n - 1) * mean * mean
    p_serial = F.when(about > 0, 2 * upper_tail(F.abs(with_next / about + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
    passes = F.least(p_chi, p_runs, p_serial) >= BATTERY

    # Text: more pairs of equal symbols, fewer changes of class.
    pairs = (s["squares"] - n) / 2
    like = lambda f: _by_encoding(s["encoding"], lambda _, t: F.lit(f(t)))
    wide = n * (n - 1) / 2 * like(lambda t: t.pairs - t.pairs**2) + n * (n - 1) * (n - 2) * like(lambda t: t.threes - t.pairs**2)
    p_pairs = upper_tail((n * (n - 1) / 2 * like(lambda t: t.pairs) - pairs) / F.sqrt(wide))
    p_changes = upper_tail((s["changes"] - 0.5 - (n - 1) * like(lambda t: t.changes)) / F.sqrt((n - 1) * like(lambda t: t.changes * (1 - t.changes))))
    # Fisher: the product's logarithm has a closed tail for two.
    log = F.least(-(F.log(F.greatest(p_pairs, F.lit(1e-150))) + F.log(F.greatest(p_changes, F.lit(1e-150)))), F.lit(600.0))
    halvings = (log - F.log(1 + log)) / 0.6931471805599453
    level = F.least(F.floor(STEPS * F.greatest(halvings, F.lit(0.0))), F.lit(LAST)).cast("int")
    grown = F.least(F.floor(F.log2(n / LEAST)), F.lit(20)).cast("int")
    return F.struct(s["start"], s["end"], s["digest"], s["encoding"], n.cast("bigint").alias("n"), grown.alias("length_class"), level.alias("level"), passes.alias("passes"))


def levels(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """Per encoding and class of length the lowest level whose expected share of text is at most ``rate``."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.encoding", "c.length_class", "c.level", "c.digest").distinct()
    counts = each.groupBy("encoding", "length_class", "level").count()
    # At most LAST + 1 rows a group from here on.
    beyond = counts.groupBy("encoding", "length_class").agg(F.collect_list(F.struct("level", "count")).alias("all"), F.sum("count").alias("m"))
    at_least = lambda a, j: F.aggregate(F.filter(a, lambda x: x["level"] >= j), F.lit(0).cast("bigint"), lambda t, x: t + x["count"])
    good = F.filter("all", lambda x: F.col("m") * F.pow(F.lit(2.0), -x["level"] / STEPS) <= rate * at_least(F.col("all"), x["level"]))
    return beyond.select("encoding", "length_class", F.array_min(F.transform(good, lambda x: x["level"])).alias("lowest")).where("lowest IS NOT NULL")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row a document: doc_id, spans: array of (start, kind, end) in order of start, then ``KINDS``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS.replace("+", "{%d,}" % (ACCESS_LEAST - 4))), ("hex", HEX.replace("+", "{%d,}" % HEX_LEAST)), ("some", CANDIDATE)):
        # Of a stretch of capitals and digits the first access key is the longest, so leaving out short ones hides none; a stretch of hex digits is one match.
        rows = with_spans(rows, name, pattern, "_text")
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_VALUE))
    rows = figures(rows, "some", "candidates")
    kind = lambda k, a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.concat(*[kind(k, name) for k, name in enumerate(KINDS[:3])])
    scanned = written(rows.select("doc_id", F.array_sort(base).alias("base"), "candidates"), "secrets")

    # One row an encoding and class of length: at most 84 pairs of numbers.
    lowest = {(r["encoding"], r["length_class"]): r["lowest"] for r in levels(scanned, rate).collect()}
    limit = lambda c: F.coalesce(*[F.when((c["encoding"] == e) & (c["length_class"] == k), F.lit(v)) for (e, k), v in sorted(lowest.items())], F.lit(LAST + 1))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
    random = F.filter("candidates", lambda c: c["passes"] & (c["level"] >= limit(c)) & free(c))
    both = F.array_sort(F.concat("base", kind(3, random)))
    named = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return scanned.select("doc_id", named.alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of each pattern's spans, their digest, and all spans as text."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return scanned.select("doc_id", *map(number, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
