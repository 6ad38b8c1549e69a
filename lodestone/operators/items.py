"""Items whose values carry a tag: ``{"name": {"S": "text"}, "n": {"N": "1"}, "m": {"M": {...}}}``.

Ten tags: S text, N number as text, B bytes in base64, BOOL, NULL, the sets SS, NS,
BS, the list L and the map M. Items are JSON text or VARIANT. What a known path
needs (predicates, keys, rules) is done where the row is, by casts between VARIANT
and maps; only what must visit values at every depth flattens items (``leaves``) and
builds them again (``assembled``), level by level from written tables.

Paths are names joined by dots and lead through M only: a missing step, or one
through anything else, is a missing value.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HASH_PREFIX, PSEUDONYM_PREFIX, all_of, base64_text, escaped_json, hmac_sha256, once
from ..plans.policy import Cohort, Profile, Rule
from .govern import rule_keys, with_keys
from .scratch import written

# The tags, by what they hold.
TEXTS, FLAGS, SETS, NESTS = ("S", "N", "B"), ("BOOL", "NULL"), ("SS", "NS", "BS"), ("L", "M")
TAGS = (*TEXTS, *FLAGS, *SETS, *NESTS)
#: Stand for an escaped backslash and an escaped quote: JSON text never holds them as they are.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def parsed(item: Column) -> Column:
    """The item as VARIANT; null where the text is no JSON."""
    return F.try_parse_json(item)


def sorted_sets(text: Column) -> Column:
    """JSON text of an item with the elements of every set in order, at any depth.

    The text is cut before each set. With escaped quotes put away, every second part
    of a piece split at quotes is inside a string, so the set ends at the first part
    outside that starts with its bracket.
    """
    mark = '"(?:SS|NS|BS)":\\['
    plain = lambda e: F.replace(F.replace(e, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    raw = lambda e: F.when(e.rlike("[\\\\\x01\x02]"), F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), plain(e), F.lit('"'))), "$", "string")).otherwise(e)
    ends = lambda parts: F.array_position(F.transform(parts, lambda p, i: (i % 2 == 0) & F.startswith(p, F.lit("]"))), True).cast("int")

    def rebuilt(piece: Column) -> Column:
        return once(F.split(piece, '"', -1), lambda parts: once(ends(parts), lambda end: ordered(parts, end)))

    def ordered(parts: Column, end: Column) -> Column:
        elements = F.filter(F.slice(parts, 1, F.greatest(end - 1, F.lit(0))), lambda p, i: i % 2 == 1)
        quoted = F.transform(F.array_sort(F.transform(elements, lambda e: F.struct(raw(e).alias("raw"), e.alias("e")))), lambda s: F.concat(F.lit('"'), s["e"], F.lit('"')))
        return F.concat(F.array_join(quoted, ","), F.array_join(F.slice(parts, end, 1 << 30), '"'))

    def joined(safe: Column) -> Column:
        marks = F.regexp_extract_all(safe, F.lit(mark), F.lit(0))
        behind = lambda pieces: F.transform(F.slice(pieces, 2, 1 << 30), rebuilt)
        return plain(once(F.split(safe, mark, -1), lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(marks, behind(pieces), lambda m, s: F.concat(m, s)), ""))))

    def in_order(t: Column) -> Column:
        safe = F.replace(F.replace(t, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
        return F.when(t.rlike(mark), once(safe, joined)).otherwise(t)

    return once(text, in_order)


def canonical(item: Column) -> Column:
    """Canonical JSON of a VARIANT item: names in order, sets in order, markup escaped."""
    return escaped_json(sorted_sets(F.to_json(item)))


def _step(name: str) -> str:
    if "'" in name and '"' in name:
        raise ValueError(f"a name with both quotes cannot be walked: {name}")
    return f'["{name}"]' if "'" in name else f"['{name}']"


def at(item: Column, path: str) -> Column:
    """The tagged value at a path, as VARIANT; null if it is missing."""
    return F.try_variant_get(item, "$" + "['M']".join(map(_step, path.split("."))), "variant")


def tag(value: Column) -> Column:
    """The tag of a tagged value; null unless it is one of the ten and stands alone."""
    return once(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), lambda keys: F.when((F.size(keys) == 1) & F.get(keys, F.lit(0)).isin(*TAGS), F.get(keys, F.lit(0))))


def matches(item: Column, path: str, expected: object) -> Column:
    """Typed equality with a scalar: S with text, N as text, BOOL and NULL with booleans; else false."""
    held = lambda t, kind: F.try_variant_get(item, "$" + "['M']".join(map(_step, path.split("."))) + f"['{t}']", kind)
    said = ("true" if expected else "false") if isinstance(expected, bool) else str(expected)
    tests = [held("N", "string") == F.lit(said)]
    if isinstance(expected, str):
        tests.append(held("S", "string") == F.lit(expected))
    if isinstance(expected, bool):
        tests += [held(t, "boolean") == F.lit(expected) for t in FLAGS]
    found = F.coalesce(*[F.when(t, F.lit(True)) for t in tests], F.lit(False))
    return found & at(item, path).isNotNull()


def eligible(rows: DataFrame, item: str, cohort: Cohort) -> DataFrame:
    """Rows whose item meets all predicates and has all keys."""
    v = F.col(item)
    return rows.where(all_of([matches(v, p, wanted) for p, wanted in cohort.predicates] + [at(v, k).isNotNull() for k in cohort.key_paths]))


def with_keys_of(rows: DataFrame, item: str, cohort: Cohort) -> DataFrame:
    """Eligible rows with a column ``key_<n>`` a key path, in order of the paths: the canonical JSON of the tagged value, as ranks take it."""
    out = eligible(rows, item, cohort)
    for n, path in enumerate(sorted(cohort.key_paths)):
        out = out.withColumn(f"key_{n}", canonical(at(F.col(item), path)))
    return out


def _refused(rule: Rule, why: str) -> Column:
    return F.raise_error(F.lit(f"rule {rule.id}: {why}"))


def _scalar(rule: Rule, value: Column, nested: Column) -> Column:
    """What a rule makes of a tagged value that is there, as VARIANT; what it may not touch fails the run."""
    if rule.action == "omit":
        return F.when(nested, _refused(rule, "lists, sets and maps cannot be changed").cast("variant"))
    text, raw = F.try_variant_get(value, "$.S", "string"), F.unbase64(F.try_variant_get(value, "$.B", "string"))

    def changed(source: Column) -> Column:
        if rule.action == "replace":
            return F.lit(rule.replacement)
        if rule.action == "hash":
            return F.concat(F.lit(HASH_PREFIX), F.sha2(source, 256))
        return F.concat(F.lit(PSEUDONYM_PREFIX), hmac_sha256(F.col(f"_i_{rule.id}"), F.col(f"_o_{rule.id}"), source))

    boxed = lambda name, v: F.to_variant_object(F.struct(v.alias(name)))
    return (
        F.when(nested, _refused(rule, "lists, sets and maps cannot be changed").cast("variant"))
        .when(text.isNotNull(), boxed("S", changed(text.cast("binary"))))
        .when(raw.isNotNull(), boxed("B", base64_text(changed(raw).cast("binary"))))
        .otherwise(_refused(rule, "the type of the value would change").cast("variant"))
    )


def _rebuilt(attributes: Column, paths: dict[str, list[str]]) -> Column:
    """The attributes (VARIANT object) with the new values of paths put in, null ones left out; called where one is met.

    ``paths``: the steps that are left to go, by the number of the columns ``_met_`` and
    ``_new_``. Each map on the way is opened once.
    """
    met = lambda below: reduce(or_, [F.col(f"_met_{n}") for n in below])
    ends = {n: steps[0] for n, steps in paths.items() if len(steps) == 1}
    inner: dict[str, dict] = {}
    for n, steps in paths.items():
        if steps[1:]:
            inner.setdefault(steps[0], {})[n] = steps[1:]

    def put(k: Column, v: Column) -> Column:
        out = v
        for name, below in inner.items():
            opened = F.to_variant_object(F.struct(_rebuilt(F.try_variant_get(v, "$.M", "variant"), below).alias("M")))
            out = F.when((k == name) & met(below), opened).otherwise(out)
        for n, name in ends.items():
            out = F.when((k == name) & F.col(f"_met_{n}"), F.col(f"_new_{n}")).otherwise(out)
        return out

    held = F.transform_values(attributes.cast("map<string,variant>"), put)
    return F.to_variant_object(F.map_filter(held, lambda k, v: v.isNotNull()) if ends else held)


def govern(rows: DataFrame, item: str, profile: Profile, resource: str, met: str = "rules_met") -> DataFrame:
    """Apply a resource's attribute rules, in order, to a column of VARIANT items.

    ``met`` lists the rules whose value was there. A missing path meets nothing; a
    list, set or map at a path, or a number or flag whose type would change, fails
    the run. Keys never appear in the plan. No rule changes a map, so a path means the same
    value before and after the rules of other paths: values are taken and changed first,
    and an item is built again once, or once more where a path has a second rule.
    """
    rules = [r for r in profile.rules if r.resource == resource and r.kind == "attribute"]
    out = with_keys(rows, rule_keys(profile, rules))
    kept, by_number = out.columns, {str(n): r for n, r in enumerate(rules)}
    turns: list[dict[str, Rule]] = []
    for n, r in by_number.items():
        turn = next((t for t in turns if all(r.path != other.path for other in t.values())), None)
        turns.append({n: r}) if turn is None else turn.update({n: r})
    for turn in turns:
        new = {n: F.col(f"_new_{n}") for n in turn}
        out = out.withColumns({f"_new_{n}": at(F.col(item), r.path) for n, r in turn.items()})
        out = out.withColumns({f"_met_{n}": v.isNotNull() for n, v in new.items()} | {f"_nested_{n}": F.when(v.isNotNull(), once(tag(v), lambda t: t.isin(*SETS, *NESTS) | t.isNull())) for n, v in new.items()})
        out = out.withColumns({f"_new_{n}": F.when(F.col(f"_met_{n}"), _scalar(r, new[n], F.col(f"_nested_{n}"))) for n, r in turn.items()})
        whole = reduce(or_, [F.col(f"_met_{n}") for n in turn])
        out = out.withColumn(item, F.when(whole, _rebuilt(F.col(item), {n: r.path.split(".") for n, r in turn.items()})).otherwise(F.col(item)))
    hit = F.array_compact(F.array(*[F.when(F.col(f"_met_{n}"), F.lit(r.id)) for n, r in by_number.items()])) if rules else F.array().cast("array<string>")
    return out.select(*[F.col(f"`{c}`") for c in kept if not c.startswith(("_i_", "_o_"))], hit.alias(met))


def rules_met(governed: DataFrame, profile: Profile, resource: str, met: str = "rules_met") -> DataFrame:
    """(rule_id, affected): each attribute rule of a resource, those that met nothing too."""
    rules = [r.id for r in profile.rules if r.resource == resource and r.kind == "attribute"]
    counts = governed.agg(*[F.count_if(F.array_contains(met, r)).alias(r) for r in rules])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(r).alias("affected")) for r in rules])).alias("r")).select("r.rule_id", "r.affected")


def leaves(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Every tagged value of VARIANT items: key, path (array of names and list places), tag, value (VARIANT, of L and M null), n (of L, M and sets, how many they hold), depth.

    One pass a level of nesting over what is nested still. Values of another form
    than a tag alone have a null tag and are not opened.
    """
    spark = rows.sparkSession

    def opened(nested: DataFrame) -> DataFrame:
        """The values inside (key, path, depth, body)."""
        inner = spark.tvf.variant_explode(F.col("body").outer()).toDF("_pos", "_key", "v")
        each = nested.lateralJoin(inner).select("key", F.concat("path", F.array(F.coalesce("_key", F.col("_pos").cast("string")))).alias("path"), (F.col("depth") + 1).alias("depth"), "v")
        return each.withColumn("tag", tag(F.col("v")))

    level = opened(rows.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.col(item).alias("body")))
    out = None
    while True:
        level = written(level, "item-level")
        text_at = lambda t: F.to_json(F.try_variant_get("v", f"$.{t}", "variant"))
        names = F.json_object_keys(text_at("M"))
        # Null where the body is of another kind than the tag says.
        held = F.coalesce(*[F.when(F.col("tag") == t, F.json_array_length(text_at(t))) for t in ("L", *SETS)], F.when((F.col("tag") == "M") & names.isNotNull(), F.size(names)))
        counted = level.withColumn("n", held)
        body = F.coalesce(*[F.when(F.col("tag") == t, F.try_variant_get("v", f"$.{t}", "variant")) for t in NESTS])
        inside = counted.where("n IS NOT NULL").select("key", "path", "depth", body.alias("body")).where("body IS NOT NULL")
        value = F.when(~F.coalesce(F.col("tag").isin(*NESTS), F.lit(False)), F.col("v"))
        part = counted.select("key", "path", "tag", value.alias("value"), "n", "depth")
        out = part if out is None else out.unionAll(part)
        if not inside.limit(1).count():
            return out
        level = opened(inside)


def assembled(flat: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, item VARIANT) of the values of ``leaves``: maps and lists are built from the deepest level up.

    ``keys`` (key) names items without any value as well. A list's places need not be
    without gaps: what is left of it stays in order.
    """
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    built = None
    for depth in range(deepest, 0, -1):
        here = flat.where(F.col("depth") == depth)
        done = here.where("value IS NOT NULL").select("key", "path", "value")
        nests = here.where("value IS NULL").select("key", "path", "tag")
        if built is not None:
            listed = F.to_variant_object(F.struct(F.transform(F.array_sort(F.transform("children", lambda c: F.struct(c["name"].cast("int").alias("at"), F.to_json(c["value"]).alias("text")))), lambda c: F.parse_json(c["text"])).alias("L")))
            mapped = F.to_variant_object(F.struct(F.to_variant_object(F.map_from_entries("children")).alias("M")))
            empty = F.when(F.col("tag") == "L", F.parse_json(F.lit('{"L":[]}'))).otherwise(F.parse_json(F.lit('{"M":{}}')))
            both = nests.join(built, ["key", "path"], "left")
            nests = both.select("key", "path", F.when(F.col("children").isNull(), empty).when(F.col("tag") == "L", listed).otherwise(mapped).alias("value"))
        else:
            nests = nests.select("key", "path", F.when(F.col("tag") == "L", F.parse_json(F.lit('{"L":[]}'))).otherwise(F.parse_json(F.lit('{"M":{}}'))).alias("value"))
        whole = done.unionAll(nests)
        parent = F.slice("path", 1, F.size("path") - 1)
        built = written(whole.groupBy("key", parent.alias("path")).agg(F.collect_list(F.struct(F.element_at("path", -1).alias("name"), F.col("value").alias("value"))).alias("children")), "item-parts")
    made = F.to_variant_object(F.map_from_entries("children"))
    items = built.select("key", made.alias("item")) if built is not None else flat.select("key", F.parse_json(F.lit("{}")).alias("item")).limit(0)
    if keys is None:
        return items
    return keys.join(items, "key", "left").select("key", F.coalesce("item", F.parse_json(F.lit("{}"))).alias("item"))


def decoded(flat: DataFrame) -> DataFrame:
    """``leaves`` with one column a kind of value: text (S, N), raw (B), flag (BOOL, NULL), members (sets, in order; of BS in base64)."""
    as_kind = lambda kind, *tags: F.coalesce(*[F.try_variant_get("value", f"$.{t}", kind) for t in tags])
    return flat.select(
        "key",
        "path",
        "tag",
        F.when(F.col("tag").isin("S", "N"), as_kind("string", "S", "N")).alias("text"),
        F.when(F.col("tag") == "B", F.unbase64(as_kind("string", "B"))).alias("raw"),
        F.when(F.col("tag").isin(*FLAGS), as_kind("boolean", *FLAGS)).alias("flag"),
        F.when(F.col("tag").isin(*SETS), F.array_sort(as_kind("array<string>", *SETS))).alias("members"),
        "n",
        "depth",
    )


def encoded(typed: DataFrame) -> DataFrame:
    """The inverse of ``decoded``: values as tagged VARIANTs again."""
    boxed = lambda name, v: F.to_variant_object(F.struct(v.alias(name)))
    value = F.when(F.col("tag") == "B", boxed("B", base64_text(F.col("raw"))))
    for kind, column in ((("S", "N"), "text"), (FLAGS, "flag"), (SETS, "members")):
        for t in kind:
            value = value.when(F.col("tag") == t, boxed(t, F.col(column)))
    return typed.select("key", "path", "tag", value.alias("value"), "n", "depth")


def malformed(flat: DataFrame) -> DataFrame:
    """(key, path): values that are no tagged value: no or several tags, an unknown tag, or a body of another kind."""
    v = lambda t, kind: F.try_variant_get("value", f"$.{t}", kind)
    kind_of = lambda t: F.schema_of_variant(F.try_variant_get("value", f"$.{t}", "variant"))
    fits = F.coalesce(
        *[F.when(F.col("tag") == t, kind_of(t) == "STRING") for t in ("S", "N")],
        F.when(F.col("tag") == "B", (kind_of("B") == "STRING") & F.try_to_binary(v("B", "string"), F.lit("base64")).isNotNull()),
        *[F.when(F.col("tag") == t, kind_of(t) == "BOOLEAN") for t in FLAGS],
        *[F.when(F.col("tag") == t, kind_of(t).isin("ARRAY<STRING>", "ARRAY<VOID>")) for t in SETS],
        F.when(F.col("tag").isin(*NESTS), F.col("n").isNotNull()),
        F.lit(False),
    )
    return flat.where(~F.coalesce(fits, F.lit(False))).select("key", "path")
