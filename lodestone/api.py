"""The commands: scan, plan, pull, inspect, compare, verify, admit, archive, unarchive."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import Options, Registry, preflight
from .operators import compare as cmp
from .operators import graph, reuse, scratch, verify
from .plans.policy import Admission, Profile
from .sources import archives, artifacts, files, ledger, readers, sinks

SCHEMA = 3


def scan(spark: SparkSession, registry: Registry, services: list[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Resources of all (or some) services; a service that fails becomes a finding."""
    found, failed = {}, {}
    for a in registry:
        if services is None or a.service in services:
            try:
                found[a.service] = a.discover(spark)
            except Exception as e:
                failed[a.service] = str(e)
    return readers.discovered(found, failed)


def plan(spark: SparkSession, registry: Registry, selected: dict[str, list[Options]]) -> dict[str, DataFrame]:
    """What a pull would do: resources, operations, findings, unresolved links. Nothing is written."""
    resources, _ = scan(spark, registry, list(selected))
    names = spark.createDataFrame([(s, o.resource) for s, all_ in selected.items() for o in all_], "service string, id string")
    chosen = resources.join(names, ["service", "id"], "left_semi")
    edges = None
    for a in registry:
        own = a.dependencies(spark)
        edges = own if edges is None else edges.unionByName(own)
    inside = edges.join(chosen.select(F.col("service").alias("from_service"), F.col("id").alias("from_id")), ["from_service", "from_id"], "left_semi")
    needed = graph.resolved(inside.where("required"), chosen)
    cycle = graph.in_cycles(chosen.select(F.concat_ws("/", "service", "type", "id").alias("node")), needed.select(F.concat_ws("/", "from_service", "from_type", "from_id").alias("node"), F.concat_ws("/", "to_service", "to_type", "to_id").alias("needs")))
    if (first := cycle.orderBy("node").first()) is not None:
        raise ValueError(f"required dependencies form a cycle through {first['node']}")
    linked = needed.select(F.col("from_service").alias("service"), F.col("from_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    steps = graph.operations(chosen.join(linked, ["service", "id"], "left"), F.coalesce("linked", F.lit(False)), F.lit(True))
    findings = [f for s, all_ in selected.items() for o in all_ for f in registry[s].validate(spark, o)]
    return {
        "resources": chosen,
        "operations": steps,
        "unresolved": graph.unresolved(inside, chosen),
        "findings": spark.createDataFrame(findings, "code string, severity string, resource string"),
    }


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def pull(spark: SparkSession, registry: Registry, selected: dict[str, list[Options]], profile: Profile | None, staged: str, target: str, account: str, captured_at: datetime | None = None, store: str | None = None) -> DataFrame:
    """Capture, govern and install a bundle; returns its checksum index.

    Rows go to bounded part files in key order, one folder a resource. Credentials in
    any line fail the run before anything is written. A bounded capture that leaves
    rows out says so (``truncated`` of the resource). With ``store``, a ledger's
    folder, each resource tells why it is captured anew, and the capture becomes the
    account's generation there once the bundle is installed.
    """
    preflight(registry)
    made = plan(spark, registry, selected)
    when = captured_at or datetime.now(UTC)
    policy = profile.identity() if profile else None
    units, _, invalid = ledger.load(spark, store, account) if store else (None, None, None)
    # One row a resource of the last capture.
    before = {r["unit"]: r["definition"] for r in units.collect()} if units is not None else {}
    resources, artifacts_ = [], None
    for service, all_ in selected.items():
        for o in all_:
            rows = registry[service].capture(spark, o, profile)
            keys = [k for k in o.key if k in rows.columns]
            lines = scratch.written(rows.select(F.lit(o.resource).alias("_of"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("_line")), "lines")
            verify.require_none(verify.credential_rows(lines, "_line", "_line"), "credentials_found")
            folder = f"data/{service}/{o.resource}"
            parts = artifacts.write_parts(lines, f"{staged}/{folder}", "_of", [f"_k{n}" for n in range(len(keys))] or ["_line"], "_line", folders=False)
            if not parts.limit(1).count():
                _put(spark, f"{staged}/{folder}/.empty", "")
            own, unit = o.definition(policy), f"{service}/{o.resource}"
            listed = parts.select(F.lit(unit).alias("unit"), F.lit("data").alias("kind"), F.concat(F.lit(f"{folder}/"), "path").alias("path"), "sha256", "size", "records")
            artifacts_ = listed if artifacts_ is None else artifacts_.unionAll(listed)
            told = {"service": service, "type": "table", "id": o.resource, "definition": own, "shape": sorted(f"{n}:{t}" for n, t in rows.dtypes), "records": lines.count(), "truncated": registry[service].truncated(spark, o)}
            if store:
                told["reason"] = reuse.table_reason(invalid == ledger.FORMAT, before.get(unit) == own, unit in before, None, None)
            resources.append(told)
    manifest = {
        "schema_version": SCHEMA,
        "source": {"account": account},
        "captured_at": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "policy": policy or "",
        "resources": resources,
        "operations": [r.asDict() for r in made["operations"].orderBy("operation_id").collect()],
        "findings": [r.asDict() for r in made["findings"].collect()],
    }
    index = artifacts_.select(F.expr("substring(path, 6)").alias("path"), "sha256", "size")
    scratch.written(index, "index").coalesce(1).write.json(f"{staged}/checksums")
    _put(spark, f"{staged}/manifest.json", json.dumps(manifest, sort_keys=True))
    sinks.install(spark, staged, target)
    if store:
        rows = [(f"{r['service']}/{r['id']}", r["definition"], r["records"]) for r in resources]
        units = spark.createDataFrame(rows, "unit string, definition string, records long")
        ledger.publish(units, artifacts_.drop("records"), target, store, account, f"{account}-{when.strftime('%Y%m%dT%H%M%S%f')}")
    return spark.read.schema("path string, sha256 string, size long").json(f"{target}/checksums")


def verify_bundle(spark: SparkSession, target: str) -> DataFrame:
    """(path, problem) of an installed bundle; no rows if it is whole."""
    index = spark.read.schema("path string, sha256 string, size long").json(f"{target}/checksums")
    found = verify.checksums(spark, f"{target}/data").where(~F.col("path").rlike(r"(^|/)[._]"))
    return verify.coverage(index, found)


def archive(spark: SparkSession, target: str, path: str) -> DataFrame:
    """Put an installed bundle, which must be whole, into one archive; its descriptor."""
    verify.require_none(verify_bundle(spark, target), "bundle_damaged")
    index = spark.read.schema("path string, sha256 string, size long").json(f"{target}/checksums")
    # The manifest and the index itself: a few small files.
    own = [("manifest.json", *files.summed(f"{target}/manifest.json")), *((f"checksums/{n}", *files.summed(f"{target}/checksums/{n}")) for n in files.listed(f"{target}/checksums"))]
    rest = spark.createDataFrame(own, "path string, sha256 string, size long")
    return archives.write_archive(index.withColumn("path", F.concat(F.lit("data/"), "path")).unionAll(rest), target, path)


def unarchive(spark: SparkSession, path: str, staged: str, target: str) -> None:
    """Install a bundle from its archive; one that is not whole is refused."""
    archives.read_archive(spark, path, None, staged)
    verify.require_none(verify_bundle(spark, staged), "bundle_damaged")
    readers.manifest(spark, f"{staged}/manifest.json")
    sinks.install(spark, staged, target)


def _listed(spark: SparkSession, manifest: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """The entries of a list of the manifest, whose fields are told; those it lacks are empty."""
    kind = dict(manifest.dtypes).get(name, "")
    schema = ", ".join(f"{out} string" for out in fields.values())
    if not kind.startswith("array<struct"):  # absent, or empty in this manifest
        return spark.createDataFrame([], schema)
    entries = manifest.select(F.explode(name).alias("e"))
    has = set(entries.select("e.*").columns)
    return entries.select(*[(F.coalesce(F.col(f"e.{c}").cast("string"), F.lit("")) if c in has else F.lit("")).alias(out) for c, out in fields.items()])


def inspect(spark: SparkSession, target: str) -> DataFrame:
    """The projection of a bundle: identity and digests of each resource, nothing of when or by what it was made."""
    found = readers.manifest(spark, f"{target}/manifest.json")
    rows = found.select("policy", F.explode("resources").alias("r"))
    data = spark.read.schema("path string, sha256 string, size long").json(f"{target}/checksums")
    parts = F.split("path", "/")
    of = data.select(F.element_at(parts, 1).alias("service"), F.element_at(parts, 2).alias("id"), F.element_at(parts, 3).alias("part"), "sha256")
    datasets = of.groupBy("service", "id").agg(cmp.ordered_digest(F.substring("part", 1, 11), F.col("sha256")).alias("dataset_digest"))
    out = rows.select("r.service", "r.type", "r.id", F.sha2(F.array_join("r.shape", ","), 256).alias("structure_digest"), F.sha2("policy", 256).alias("governance_digest"), F.lit(True).alias("selected"), "r.records")
    operations = _listed(spark, found, "operations", {"service": "service", "id": "resource_id", "stage": "stage", "action": "action"})
    findings = _listed(spark, found, "findings", {"code": "code", "severity": "severity", "resource": "resource", "property": "property"})
    return cmp.grouped_to(out.join(datasets, ["service", "id"], "left"), operations, findings)


def compare(spark: SparkSession, baseline: str, current: str) -> DataFrame:
    """The receipt of two bundles."""
    return cmp.receipt(inspect(spark, baseline), inspect(spark, current))


def admit(spark: SparkSession, target: str, policy: Admission, now: datetime) -> DataFrame:
    """Whether a bundle may be used: it must be whole, and meet the policy."""
    verify.require_none(verify_bundle(spark, target), "bundle_damaged")
    found = readers.manifest(spark, f"{target}/manifest.json")
    facts = found.select(F.lit(target).alias("id"), F.col("source.account").alias("account"), F.to_timestamp_ntz("captured_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("captured_at"), F.lit(None).cast("string").alias("repository"), F.lit(None).cast("string").alias("workflow"))
    has = dict(found.dtypes)["findings"] != "array<string>"
    findings = found.select(F.lit(target).alias("id"), F.explode("findings").alias("f")).select("id", "f.code", "f.severity") if has else spark.createDataFrame([], "id string, code string, severity string")
    return verify.admission_reasons(facts, findings, policy, now)
