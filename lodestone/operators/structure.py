"""Structures of resources: pruning, ordering, optional settings, and what their errors mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once

# Stand-ins for what must not be taken for structure inside strings. JSON text never holds these characters as they are.
_HELD = {"\\\\": "\x01", '\\"': "\x02", "{": "\x03", "}": "\x04", "[": "\x05", "]": "\x06", ",": "\x07", ":": "\x0e"}
_EMPTY = r'(?:null|""|\[\]|\{\}|-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?)'
# What a failed read of a setting means.
CANCELLED = ("Canceled", "DeadlineExceeded")
ABSENT = {
    "policy": ("NoSuchBucketPolicy",),
    "cors": ("NoSuchCORSConfiguration",),
    "lifecycle": ("NoSuchLifecycleConfiguration",),
    "encryption": ("ServerSideEncryptionConfigurationNotFoundError",),
    "website": ("NoSuchWebsiteConfiguration",),
    "tags": ("NoSuchTagSet",),
    "public_access_block": ("NoSuchPublicAccessBlockConfiguration",),
    "object_lock": ("ObjectLockConfigurationNotFoundError",),
}


def _outside(text: Column) -> Column:
    """JSON text in which strings hold no quotes, brackets, commas or colons."""
    safe = text
    for said in ("\\\\", '\\"'):
        safe = F.replace(safe, F.lit(said), F.lit(_HELD[said]))
    signs = "{}[],:"
    hidden = "".join(_HELD[s] for s in signs)
    parts = F.transform(F.split(safe, '"', -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, signs, hidden)).otherwise(p))
    return F.array_join(parts, '"')


def _inside(text: Column) -> Column:
    """The inverse of ``_outside``."""
    signs = "{}[],:"
    text = F.translate(text, "".join(_HELD[s] for s in signs), signs)
    return F.replace(F.replace(text, F.lit(_HELD['\\"']), F.lit('\\"')), F.lit(_HELD["\\\\"]), F.lit("\\\\"))


def depth(text: Column) -> Column:
    """How deep the objects of JSON text lie in each other."""
    return _depth(_outside(text))


def _depth(outside: Column) -> Column:
    brackets = F.split(F.regexp_replace(outside, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, start, step)["most"]


def pruned(text: Column) -> Column:
    """Canonical JSON without the members that are null, "", 0, [] or {}, at any depth; text that is no JSON is null.

    Members that become empty go as well, so a level of objects is cleaned a pass, from
    the deepest up, and there are as many passes as levels. Elements of lists stay,
    cleaned inside; false stays; the whole stays, if only as {}.
    """
    first = '"[^"]*":' + _EMPTY + ","
    last = ',?"[^"]*":' + _EMPTY + r"(?=\})"
    one = lambda t, _: F.regexp_replace(F.regexp_replace(t, first, ""), last, "")
    cleaned = lambda outside: F.aggregate(F.sequence(F.lit(1), F.greatest(_depth(outside), F.lit(1))), outside, one)
    return once(F.to_json(F.try_parse_json(text)), lambda canonical: F.when(canonical.isNotNull(), _inside(once(_outside(canonical), cleaned))))


def _keyed(by: list[str]):
    return lambda x: F.struct(*[x[c].alias(f"_{c}") for c in by], x.alias("x"))


def in_order(rows: DataFrame, arrays: dict[str, list[str]]) -> DataFrame:
    """Rows whose arrays of structs are sorted by the fields named, of strings by themselves; null arrays are empty."""
    for column, by in arrays.items():
        of = rows.schema[column].dataType
        value = F.coalesce(F.col(column), F.array().cast(of))
        if by:
            sort_by = F.transform(value, _keyed(by))
            rows = rows.withColumn(column, F.transform(F.array_sort(sort_by), lambda x: x["x"]))
        else:
            rows = rows.withColumn(column, F.array_sort(value))
    return rows


def billed(rows: DataFrame, mode: str = "billing_mode", read: str = "read_capacity", write: str = "write_capacity", keep_provisioned: bool = False) -> DataFrame:
    """What a copy is billed by: requests, unless provisioned capacity was there and is kept; what the source had is told."""
    source = F.when(F.coalesce(F.col(mode), F.lit("")) != "", F.col(mode)).when(F.col(read).isNotNull(), F.lit("PROVISIONED")).otherwise(F.lit("PAY_PER_REQUEST"))
    kept = F.lit(keep_provisioned) & (F.col("source_billing_mode") == "PROVISIONED")
    out = rows.withColumn("source_billing_mode", source)
    return out.withColumn(mode, F.when(kept, "PROVISIONED").otherwise("PAY_PER_REQUEST")).withColumn(read, F.when(kept, F.col(read))).withColumn(write, F.when(kept, F.col(write)))


def error_class(setting: Column, code: Column) -> Column:
    """What reading a setting came to: present, absent, cancelled, access_denied, authentication or configuration."""
    known = F.lit(False)
    for name, codes in ABSENT.items():
        known = known | ((setting == name) & code.isin(*codes))
    low = F.lower(code)
    return (
        F.when(code.isNull(), "present")
        .when(code.isin(*CANCELLED), "cancelled")
        .when(F.coalesce(known, F.lit(False)), "absent")
        .when(low.contains("accessdenied") | low.contains("unauthorized"), "access_denied")
        .when(low.contains("expiredtoken") | low.contains("invalidclienttoken"), "authentication")
        .otherwise("configuration")
    )


def settings(reads: DataFrame, resource: str, setting: str = "setting", value: str = "value", code: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """Each resource with its settings, and a finding for each that could not be read.

    ``reads``: one row a resource and setting, with JSON or an error. An absent setting
    is none, and no error; a cancelled read fails the run.
    """
    told = reads.select(resource, F.col(setting).alias("setting"), pruned(F.col(value)).alias("value"), error_class(F.col(setting), F.col(code)).alias("kind"))
    told = told.withColumn("kind", F.when(F.col("kind") == "cancelled", F.raise_error(F.lit("the capture was cancelled")).cast("string")).otherwise(F.col("kind")))
    pair = F.when((F.col("kind") == "present") & F.col("value").isNotNull() & ~F.col("value").isin("{}", "[]", "null", '""'), F.struct("setting", "value"))
    # At most as many pairs a resource as there are settings.
    structures = told.groupBy(resource).agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("settings"))
    findings = told.where(~F.col("kind").isin("present", "absent")).select(resource, F.concat(F.upper("setting"), F.lit("_UNAVAILABLE")).alias("code"), F.lit("warning").alias("severity"), F.lit("partial").alias("support"), F.col("setting").alias("property"), F.col("kind").alias("reason"))
    return structures, findings


def pinned(rows: DataFrame, account: str, expected: str) -> DataFrame:
    """Rows of the expected account; a row of another, or of none, fails the run. Without an expected account all pass."""
    if not expected:
        return rows
    other = ~F.coalesce(F.col(account) == expected, F.lit(False))
    told = F.concat(F.lit("source_account_mismatch: expected "), F.lit(expected), F.lit(", got "), F.coalesce(F.col(account).cast("string"), F.lit("none")))
    return rows.withColumn(account, F.when(other, F.raise_error(told).cast("string")).otherwise(F.col(account)))


def mismatches(rows: DataFrame, account: str, expected: str) -> DataFrame:
    """Rows that ``pinned`` would refuse."""
    return rows.where(~F.coalesce(F.col(account) == expected, F.lit(False)))
