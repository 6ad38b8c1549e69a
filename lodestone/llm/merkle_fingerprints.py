"""Document fingerprints as Merkle trees; DataFrame functions only.

A text is cut into sections (at blank lines), sections into paragraphs (lines),
and paragraphs into leaves: sentences, a long one in stretches of ``LEAF_CHARS``
counted from its start. A leaf's hash is of its text; a paragraph's is of its
leaves' hashes, a section's of its paragraphs', the root's of the sections'. The
fingerprint is the whole tree as text:

    root . section:n_paragraphs,... . paragraph:n_leaves,... . leaf,leaf,...

Equal roots mean equal texts. Where roots differ, ``differing_paragraphs`` walks
down: only under sections and paragraphs whose hashes differ can there be an
edit. ``likeness`` is the share of leaves that two trees have in common
(2 |A and B| / (|A| + |B|) over distinct leaves; 1 for equal roots).

Defined results: a null text counts as empty, and two empty texts are alike (1),
an empty and another are not (0); very long texts are fingerprinted whole; repeated
rows give repeated rows; rows with one key follow each other by text; a null key
sorts last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_CHARS = 48
LEAF_HEX = 8
NODE_HEX = 12
ROOT_HEX = 32
SLICES = 4096

# Java and RE2 read these alike.
SECTION_BREAK = "\n[ \t\r]*\n[ \t\r\n]*"
LEAF = "[^.!?]{1,%d}[.!?]*|[.!?]+" % LEAF_CHARS


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text column, as a string column."""
    sections = F.transform(
        F.split(F.coalesce(text, F.lit("")), SECTION_BREAK),
        lambda s: F.transform(
            F.split(s, "\n"),
            lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.md5(x), 1, LEAF_HEX)),
        ),
    )
    # (hash, number of leaves, leaves) of each paragraph, by section
    paragraphs = F.transform(
        sections,
        lambda s: F.transform(s, lambda p: F.struct(F.substring(F.md5(F.array_join(p, ",")), 1, NODE_HEX).alias("h"), F.size(p).alias("n"), F.array_join(p, ",").alias("leaves"))),
    )
    nodes = F.transform(
        paragraphs,
        lambda s: F.struct(
            F.substring(F.md5(F.array_join(s["h"], ",")), 1, NODE_HEX).alias("h"),
            F.size(s).alias("n"),
            F.array_join(F.transform(s, lambda p: F.concat(p["h"], F.lit(":"), p["n"].cast("string"))), ",").alias("paragraphs"),
            F.array_join(F.filter(s["leaves"], lambda x: x != ""), ",").alias("leaves"),
        ),
    )
    return F.transform(
        F.array(nodes),
        lambda t: F.concat_ws(
            ".",
            F.substring(F.sha2(F.concat(F.array_join(t["h"], ","), F.lit("/"), F.coalesce(text, F.lit(""))), 256), 1, ROOT_HEX),
            F.array_join(F.transform(t, lambda s: F.concat(s["h"], F.lit(":"), s["n"].cast("string"))), ","),
            F.array_join(t["paragraphs"], ","),
            F.array_join(F.filter(t["leaves"], lambda x: x != ""), ","),
        ),
    )[0]


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.element_at(F.split(fp, "\\."), 4), ","), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1, to 6 places."""
    shared = F.size(F.array_intersect(leaves(a), leaves(b)))
    both = F.size(leaves(a)) + F.size(leaves(b))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.round(2.0 * shared / both, 6))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """The 0-based places of the paragraphs of ``b`` that ``a`` does not have.

    Only sections of ``b`` that ``a`` does not have are opened.
    """
    level = lambda fp, k: F.split(F.element_at(F.split(fp, "\\."), k), ",")
    hashes = lambda nodes: F.transform(nodes, lambda p: F.substring(p, 1, NODE_HEX))
    # One element, so that each list is made once.
    both = F.array(F.struct(hashes(level(a, 2)).alias("sa"), level(b, 2).alias("sb"), hashes(level(a, 3)).alias("pa"), hashes(level(b, 3)).alias("pb")))
    is_new = lambda x, s: ~F.array_contains(x["sa"], F.substring(s, 1, NODE_HEX))
    n_paragraphs = lambda s: F.substring(s, NODE_HEX + 2, 12).cast("int")
    opened = F.transform(both, lambda x: F.struct(x["pa"].alias("pa"), x["pb"].alias("pb"), F.flatten(F.transform(x["sb"], lambda s: F.array_repeat(is_new(x, s), n_paragraphs(s)))).alias("open")))
    candidates = lambda x: F.filter(x["pb"], lambda p, k: F.get(x["open"], k))
    missing = F.transform(opened, lambda x: F.struct(x["pb"].alias("pb"), x["open"].alias("open"), F.array_except(candidates(x), x["pa"]).alias("new")))
    places = F.transform(missing, lambda x: F.array_compact(F.transform(x["pb"], lambda p, k: F.when(F.get(x["open"], k) & F.array_contains(x["new"], p), k))))[0]
    return F.when(F.substring(a, 1, ROOT_HEX) == F.substring(b, 1, ROOT_HEX), F.array().cast("array<int>")).otherwise(places)


def edited_text(text: Column, donor: Column) -> Column:
    """``text`` whose last floor(n/3) characters are the first as many of ``donor``."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - cut).cast("int")), F.substring(donor, F.lit(1), cut))


def with_next(rows: DataFrame, key: str, carried: list[str], slices: int = SLICES) -> DataFrame:
    """Add to each row ``next_<c>`` of the row with the next lower key (the first row's after the last).

    Rows are dealt into equal slices of the key's range, each sorted by itself;
    only a slice's last row looks to the next slice, through a table of one row a
    slice. So no task sees more than its slice, whatever the number of rows.
    """
    span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span and span["lo"] is not None else (0, 0)
    width = (hi - lo) // slices + 1
    # Slices count upwards as keys fall; null keys come last.
    at = F.coalesce(F.floor((F.lit(hi) - F.col(key)) / width), F.lit(slices + 1)).cast("long")
    order = [F.col(key).desc_nulls_last(), *[F.col(c) for c in carried]]
    here = Window.partitionBy("_slice").orderBy(*order)
    rows = rows.withColumn("_slice", at)
    # The first row of each slice, and for each slice the next one that has rows.
    first = rows.withColumn("_rn", F.row_number().over(here)).where(F.col("_rn") == 1).select(F.col("_slice").alias("_to"), F.struct(*carried).alias("_first"))
    used = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    whole = Window.orderBy("_slice")  # one row a slice: at most ``slices`` + 2
    around = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = used.select("_slice", F.coalesce(F.lead("_slice").over(whole), F.min("_slice").over(around)).alias("_to"))
    after = links.join(first, "_to").drop("_to")
    led = rows.withColumn("_lead", F.lead(F.struct(*carried)).over(here)).join(after, "_slice", "left")
    return led.select(*rows.columns, *[F.coalesce("_lead", "_first")[c].alias(f"next_{c}") for c in carried]).drop("_slice")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness; see the module."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"]).withColumn("_edited", edited_text(F.col("text"), F.col("next_text")))
    prints = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("_edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("_next"),
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
        differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"),
    )
