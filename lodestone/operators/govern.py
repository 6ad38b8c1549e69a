"""Applying governance rules to items, object metadata and object bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import PSEUDONYM_PREFIX, count_bucket, hmac_sha256, media_type, public_hash
from ..plans.policy import Profile, Rule, pads


def key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """One row of key pads, so that no key is a literal in any plan."""
    values, columns = [], []
    for name, key in keys.items():
        for side, pad in zip(("i", "o"), pads(key)):
            columns.append(f"_{side}_{name} binary")
            values.append(bytearray(pad))
    return spark.createDataFrame([tuple(values)], ", ".join(columns))


def with_keys(rows: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Rows with the pad columns of the keys beside them: one row, so a broadcast of fixed size."""
    if not keys:
        return rows
    one = key_table(rows.sparkSession, keys).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def action(rule: Rule, value: Column) -> Column:
    """What a rule makes of a value; null (missing) stays null."""
    if rule.action == "omit":
        return F.lit(None).cast("string")
    if rule.action == "replace":
        return F.when(value.isNotNull(), F.lit(rule.replacement))
    if rule.action == "hash":
        return public_hash(value)
    return F.concat(F.lit(PSEUDONYM_PREFIX), hmac_sha256(F.col(f"_i_{rule.id}"), F.col(f"_o_{rule.id}"), value))


def rule_keys(profile: Profile, rules: list[Rule]) -> dict[str, bytes]:
    return {r.id: profile.rule_key(r) for r in rules if r.action == "pseudonymize"}


def value_at(rows: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """The value at a path and its type: a column by its whole name, or steps through structs and maps.

    None where no row can have it: no such column, or no such field in a struct. A
    path through anything else is refused.
    """
    if path in rows.columns:
        return F.col(f"`{path}`"), rows.schema[path].dataType
    first, *steps = path.split(".")
    if first not in rows.columns:
        return None
    value, kind = F.col(f"`{first}`"), rows.schema[first].dataType
    for step in steps:
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return None
            value, kind = value[step], kind[step].dataType
        elif isinstance(kind, T.VariantType):
            raise TypeError(f"{path} leads into tagged items: see operators.items")
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            value, kind = value[step], kind.valueType
        else:
            raise TypeError(f"{path} cannot be walked: {step} is looked for in {kind.simpleString()}")
    return value, kind


def _changed(value: Column, kind: T.DataType, steps: list[str], rule: Rule) -> Column:
    """A struct or map with the rule applied at the steps below it."""
    name, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType):
        if name not in kind.names:
            return value
        if not rest and rule.action == "omit":
            return value.dropFields(name) if len(kind.names) > 1 else F.lit(None).cast("struct<>")
        inner = _changed(value[name], kind[name].dataType, rest, rule) if rest else action(rule, value[name])
        return value.withField(name, inner)
    if not rest and rule.action == "omit":
        return F.map_filter(value, lambda k, v: k != name)
    inner = (lambda v: _changed(v, kind.valueType, rest, rule)) if rest else (lambda v: action(rule, v))
    return F.transform_values(value, lambda k, v: F.when(k == name, inner(v)).otherwise(v))


def govern_attributes(rows: DataFrame, profile: Profile, resource: str) -> DataFrame:
    """Apply a resource's attribute rules, in order, to columns and to paths through structs and maps.

    A rule whose path leads through anything else, or to a value that is no string
    (or binary, outside a map), is refused before anything runs, but for omit, which
    needs a scalar. A path that no row can have meets nothing.
    """
    rules = [r for r in profile.rules if r.resource == resource and r.kind == "attribute"]
    for r in rules:
        if found := value_at(rows, r.path):
            kind = found[1].simpleString()
            within_map = r.path not in rows.columns and isinstance(value_at(rows, r.path.rpartition(".")[0])[1], T.MapType)
            if kind.startswith(("array", "map", "struct", "variant")) or r.action != "omit" and kind not in ("string", "binary")[: 1 if within_map else 2]:
                raise TypeError(f"rule {r.id} cannot change {r.path}, which is {kind}")
    out = with_keys(rows, rule_keys(profile, rules))
    for r in rules:
        if r.path in out.columns:
            out = out.drop(r.path) if r.action == "omit" else out.withColumn(r.path, action(r, F.col(f"`{r.path}`")))
        elif value_at(out, r.path):
            first, *steps = r.path.split(".")
            out = out.withColumn(first, _changed(F.col(f"`{first}`"), out.schema[first].dataType, steps, r))
    return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_o_"))])


def rule_counts(rows: DataFrame, profile: Profile, resource: str) -> DataFrame:
    """rule_id, affected, bucket: each rule of a resource, those that met nothing too."""
    rules = [r for r in profile.rules if r.resource == resource]
    found = {r.id: value_at(rows, r.path) for r in rules}
    present = [F.count(at[0]).alias(i) if at else F.lit(0).cast("bigint").alias(i) for i, at in found.items()]
    counts = rows.agg(*present)
    pairs = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(r.id).alias("affected")) for r in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.rule_id", "r.affected").withColumn("bucket", count_bucket(F.col("affected")))


def govern_metadata(metadata: Column, rules: list[Rule]) -> Column:
    """Apply metadata rules to a map column: names match whatever their case; omit ends the chain."""
    for r in rules:
        metadata = _metadata_rule(metadata, r)
    return metadata


def _metadata_rule(metadata: Column, rule: Rule) -> Column:
    name = rule.path.lower()
    if rule.action == "omit":
        return F.map_filter(metadata, lambda k, v: F.lower(k) != name)
    return F.transform_values(metadata, lambda k, v: F.when(F.lower(k) == name, action(rule, v)).otherwise(v))


def body_violations(objects: DataFrame, rule: Rule, content_type: str = "content_type") -> DataFrame:
    """Objects whose media type the body rule does not allow."""
    return objects.where(~F.coalesce(media_type(F.col(content_type)).isin(*rule.content_types), F.lit(False)))


def govern_body(objects: DataFrame, rule: Rule, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Apply a body rule; a media type off its list fails the run. Omit leaves an empty body."""
    allowed = F.coalesce(media_type(F.col(content_type)).isin(*rule.content_types), F.lit(False))
    made = F.lit("") if rule.action == "omit" else action(rule, F.col(body))
    return objects.withColumn(body, F.when(allowed, made).otherwise(F.raise_error(F.lit("content type is not allowed")).cast("string")))


def output_size(rule: Rule, size: Column) -> Column:
    """The size that a body rule's output will have."""
    fixed = {"omit": 0, "replace": len(rule.replacement.encode()), "hash": len("hash/v1:") + 64, "pseudonymize": len(PSEUDONYM_PREFIX) + 64}
    return F.when(size.isNotNull(), F.lit(fixed[rule.action]).cast("bigint"))
