"""Column builders: digests, keyed digests, canonical text, buckets, names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and bounds that stored data carries.
HASH_PREFIX = "hash/v1:"
PSEUDONYM_PREFIX = "pseudonym/v1:"
BUCKETS = ((1, "0"), (10, "1-9"), (100, "10-99"), (1000, "100-999"))
TOP_BUCKET = "1000+"
CREDENTIALS = (
    "(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"""(?i)["']?(aws_secret_access_key|aws_session_token|x-amz-security-token|accesskeyid|secretaccesskey|sessiontoken)["']?\s*[:=]\s*["']?[^\s"']{16}""",
)
ACCOUNT = "^[0-9]{12}$"
OPAQUE_NAME = "^[A-Za-z][A-Za-z0-9_-]{0,63}$"
PARTITIONS = ("aws", "aws-us-gov", "aws-cn", "aws-iso", "aws-iso-b", "aws-iso-e", "aws-iso-f", "aws-eusc")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it names several times: the value is worked out once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def public_hash(value: Column) -> Column:
    """Unkeyed digest with its version prefix; null stays null (a missing value)."""
    return F.concat(F.lit(HASH_PREFIX), F.sha2(value.cast("binary"), 256))


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 from the two 64-byte key pads, as binary columns."""
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def length_prefix(value: Column) -> Column:
    """The 8-byte big-endian length of a value's bytes, before the bytes."""
    raw = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("bigint")), 16, "0")), raw)


def base64_text(value: Column) -> Column:
    """Base64 in one line: Spark breaks lines after 76 characters."""
    return F.regexp_replace(F.base64(value), "\\s", "")


def escaped_json(text: Column) -> Column:
    """Canonical JSON text with <, >, & and the line separators written as escapes."""
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def canonical_item(fields: dict[str, Column]) -> Column:
    """An item as canonical JSON: attributes in name order, null ones left out."""
    return escaped_json(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])))


def typed(kind: str, value: Column) -> Column:
    """A tagged attribute value; numbers are text, sets are sorted as text."""
    if kind in ("SS", "NS"):
        value = F.array_sort(F.transform(value, lambda x: x.cast("string")))
    elif kind == "BS":
        value = F.array_sort(F.transform(value, base64_text))
    elif kind == "B":
        value = base64_text(value)
    elif kind in ("S", "N"):
        value = value.cast("string")
    return F.when(value.isNotNull(), F.struct(value.alias(kind)))


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def count_bucket(n: Column) -> Column:
    """A count as one of the five ranges that may be told."""
    out = F.lit(TOP_BUCKET)
    for below, name in reversed(BUCKETS):
        out = F.when(n < below, name).otherwise(out)
    return out


def bytes_label(n: Column) -> Column:
    one = lambda unit, size: F.format_string(f"%.1f {unit}", n.cast("double") / size)
    return F.when(n >= 1 << 30, one("GiB", 1 << 30)).when(n >= 1 << 20, one("MiB", 1 << 20)).when(n >= 1 << 10, one("KiB", 1 << 10)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def bounded_message(text: Column, most: int) -> Column:
    """White space collapsed, at most ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def visible(text: Column) -> Column:
    """Control characters written as escapes."""
    for code in (*range(0, 32), 127):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return text


def safe_path(path: Column) -> Column:
    """Whether a path is relative, clean, and stays below its root."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.contains("\\") & ~odd, F.lit(False))


def has_credentials(text: Column) -> Column:
    """Whether one of ``CREDENTIALS`` is found; few texts hold a part that each match has, and only those are searched by pattern."""
    ids = text.contains("AKIA") | text.contains("ASIA")
    names = once(F.lower(text), lambda low: low.contains("access") | low.contains("token"))
    found = reduce(lambda a, b: a | b, [part & text.rlike(p) for part, p in zip((ids, names), CREDENTIALS, strict=True)])
    return F.coalesce(found, F.lit(False))


def arn_part(arn: Column, n: int) -> Column:
    """The n-th (from 1) of the six parts of a resource name; the last keeps its colons."""
    parts = F.split(arn, ":", 6)
    return F.when(F.size(parts) >= n, F.element_at(parts, n))


def valid_arn(arn: Column, service: str) -> Column:
    ok = [arn_part(arn, 1) == "arn", arn_part(arn, 2).isin(*PARTITIONS), arn_part(arn, 3) == service, arn_part(arn, 4) != "", arn_part(arn, 5).rlike(ACCOUNT), arn_part(arn, 6) != ""]
    return F.coalesce(all_of(ok), F.lit(False))


def same_log_group(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, r":\*$", "") == F.regexp_replace(b, r":\*$", "")


def names_secret(resource: Column, name: Column) -> Column:
    """Exact, or the name with a dash and six letters or digits."""
    suffix = F.substr(resource, F.length(name) + 1)
    return (resource == name) | (F.startswith(resource, name) & suffix.rlike("^-[A-Za-z0-9]{6}$"))


def object_name(bucket: Column, key: Column) -> Column:
    return F.concat(F.sha2(F.concat(bucket.cast("binary"), F.unhex(F.lit("00")), key.cast("binary")), 256), F.lit(".bin"))


def table_folder(name: Column) -> Column:
    return F.substring(F.sha2(name.cast("binary"), 256), 1, 32)


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))


def scaled(value: Column, numerator: Column, denominator: Column) -> Column:
    """value * numerator / denominator as a whole number; 0 where the divisor is."""
    return F.when(denominator > 0, (value.cast("double") * numerator.cast("double") / denominator.cast("double")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def required_space(payload: Column, copies: int) -> Column:
    """Payload times copies, and 15 % more or 1 GiB, whichever is larger."""
    total = payload * copies
    return total + F.greatest(F.floor(total * 15 / 100).cast("bigint"), F.lit(1 << 30))
