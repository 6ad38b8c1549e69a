"""Artifacts written in tasks: chunks of NDJSON lines, and tar.gz packs with an index.

Where a file ends is decided beforehand (``operators.packing``), so each file is the
work of one task and no larger than its bound, and a record is never cut. Tasks
stream: a record at a time goes through the digest and the compressor to the file.
Every attempt of a task writes files of its own name; those of finished attempts are
then renamed to their final names, which do not depend on attempts. What a write
returns is a written table with one descriptor row a file.

Bytes of files depend on records and order only: gzip headers hold no time, members
of archives have mode 0600 and time 0.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import has_credentials, object_name, table_folder
from ..operators.bounds import byte_limit
from ..operators.packing import CHUNK_BYTES, PACK_BYTES, PACK_OBJECTS, pack
from ..operators.scratch import tasks, written
from . import files

# What files are called and what they are said to hold.
NDJSON, GZIP = "application/x-ndjson", "application/gzip"
TASK_BYTES = 32 << 20


def _named(rows: DataFrame, resource: str) -> DataFrame:
    """The folder of each resource: the first 16 bytes of its digest."""
    return rows.withColumn("_base", table_folder(F.coalesce(F.col(resource).cast("string"), F.lit(""))))


def _committed(drafts: DataFrame, root: str, names: list[tuple[str, str]]) -> DataFrame:
    """Rename the files of finished attempts; pairs of columns: the draft's path and the final one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draft, final in names:
                for a, b in zip(batch.column(draft).to_pylist(), batch.column(final).to_pylist()):
                    files.moved(f"{root}/{a}", f"{root}/{b}")
            yield batch.drop_columns([draft for draft, _ in names])

    gone = {draft for draft, _ in names}
    return written(drafts.mapInArrow(run, T.StructType([f for f in drafts.schema if f.name not in gone])), "descriptors")


def write_parts(rows: DataFrame, root: str, resource: str, order: list[str], line: str, max_bytes: int = CHUNK_BYTES, compressed: bool = True, oversize: str = "alone", folders: bool = True) -> DataFrame:
    """Write lines as part files, a resource's in order, none over ``max_bytes`` of lines and line ends.

    Each resource has a folder, or without ``folders`` all files lie in ``root``, which
    is for one resource.

    One row a file: resource, part, path, records, source_bytes, size, sha256,
    media_type. A line over the bound sits alone, or with ``oversize="fail"`` is refused:
    nothing is written then. Null lines are left out.
    """
    if oversize not in ("alone", "fail"):
        raise ValueError(f"unknown way with lines over the bound: {oversize}")
    root = root.rstrip("/")
    sized = rows.where(F.col(line).isNotNull()).select(resource, *order, F.col(line).alias("_line")).withColumn("_bytes", (F.octet_length("_line") + 1).cast("bigint"))
    if oversize == "fail" and sized.where(F.col("_bytes") > max_bytes).limit(1).count():
        raise ValueError(f"a record has more than {max_bytes} bytes")
    packed = _named(pack(sized, resource, order, "_bytes", max_bytes, name="_part", carried=["_line"]), resource)
    packed = packed if folders else packed.withColumn("_base", F.lit(""))
    lines = packed.repartition(resource, "_part").sortWithinPartitions(resource, "_part", *order, "_bytes", "_line").select(resource, "_part", "_base", "_line")
    ending = ".ndjson.gz" if compressed else ".ndjson"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fresh = object()
        now, out, stream, counts, done = fresh, None, None, [0, 0], []

        def close() -> None:
            stream.close()
            who, part, base = now
            out.out.close()
            final = f"{base}/part-{part:06d}{ending}".lstrip("/")
            done.append((who, part, f"{final}.{attempt}", final, *counts, out.size, out.sha256, GZIP if compressed else NDJSON))

        for batch in batches:
            for who, part, base, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is fresh or (who, part) != now[:2]:
                    if now is not fresh:
                        close()
                    now, counts = (who, part, base), [0, 0]
                    out = files.Digested(files.created(f"{root}/" + f"{base}/part-{part:06d}{ending}.{attempt}".lstrip("/")))
                    stream = gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) if compressed else io.BufferedWriter(_Raw(out))
                raw = text.encode("utf-8", "surrogatepass") + b"\n"
                stream.write(raw)
                counts = [counts[0] + 1, counts[1] + len(raw)]
        if now is not fresh:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.names)

    who = rows.schema[resource]
    schema = T.StructType([who]).add("part", "long").add("draft", "string").add("path", "string").add("records", "long").add("source_bytes", "long").add("size", "long").add("sha256", "string").add("media_type", "string")
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return _committed(written(lines.mapInArrow(run, schema), "part-drafts"), root, [("draft", "path")])


class _Raw(io.RawIOBase):
    """A digest as a raw stream, so that lines are written in larger pieces."""

    def __init__(self, out: files.Digested):
        self.held = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.held.write(bytes(data))


def write_bounded(rows: DataFrame, root: str, order: list[str], line: str, max_records: int, max_bytes: int, compressed: bool = False) -> DataFrame:
    """The leading lines within a count and a sum of bytes, as one file; the first that does not fit ends it.

    One descriptor row as of ``write_parts``, with ``truncated``: whether lines were left
    out. No row if no line fits.
    """
    lines = rows.where(F.col(line).isNotNull()).select(*order, F.col(line).alias("_text"))
    kept = byte_limit(lines, order, F.col("_text"), max_records, max_bytes).withColumn("_one", F.lit("all"))
    held = written(kept.select("_one", *order, "_text"), "bounded")
    more = lines.limit(held.count() + 1).count() > held.count()
    return write_parts(held, root, "_one", order, "_text", max(max_bytes, 1), compressed).drop("_one").withColumn("truncated", F.lit(more))


def _clean(objects: DataFrame, body: str) -> Column:
    """Bodies as bytes, null ones empty; one with credentials fails the run."""
    raw = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    suspect = has_credentials(F.decode(raw, "utf-8") if objects.schema[body].dataType == T.BinaryType() else F.col(body))
    return F.when(suspect, F.raise_error(F.lit("an object holds credentials")).cast("binary")).otherwise(raw)


def write_packs(objects: DataFrame, root: str, resource: str, key: str, body: str, described: list[str] | None = None, max_bytes: int = PACK_BYTES, max_objects: int = PACK_OBJECTS) -> DataFrame:
    """Write objects as tar.gz packs in key order, each with an index of one JSON line an object.

    ``described`` are columns that the index tells (nulls are left out). A null body is
    empty. A body with credentials fails the run. One row a pack: resource, pack,
    records, source_bytes, and of the pack and its index path, size, sha256
    (``index_``...).
    """
    described = described or []
    sized = objects.select(resource, F.col(key).cast("string").alias("_key"), F.col(body).alias("_body"), F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("_bytes"), F.struct(*described).alias("_of") if described else F.lit(None).alias("_of"))
    packed = pack(sized, resource, ["_key"], "_bytes", max_bytes, max_objects, name="_pack", carried=["_body", "_of"])
    named = packed.select(resource, "_pack", "_key", "_body", *[F.col("_of")[c].alias(c) for c in described])
    return write_packed(named, root, resource, "_pack", "_key", "_body", described)


def write_packed(objects: DataFrame, root: str, resource: str, number: str, key: str, body: str, described: list[str] | None = None) -> DataFrame:
    """As ``write_packs``, of objects whose packs are numbered already."""
    root, described = root.rstrip("/"), described or []
    told = F.to_json(F.struct(*[F.col(c) for c in described])) if described else F.lit("{}")
    packed = _named(objects.select(resource, F.col(number).cast("bigint").alias("_pack"), F.col(key).cast("string").alias("_key"), _clean(objects, body).alias("_body"), told.alias("_told")), resource)
    member = object_name(F.coalesce(F.col(resource).cast("string"), F.lit("")), F.col("_key"))
    members = packed.repartition(resource, "_pack").sortWithinPartitions(resource, "_pack", "_key").select(resource, "_pack", "_base", "_key", member.alias("_name"), "_body", "_told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fresh = object()
        now, open_, done = fresh, None, []

        def begin(base: str, number: int):
            name = f"{base}/pack-{number:06d}"
            sides = []
            for ending in (".tar.gz", ".index.ndjson.gz"):
                out = files.Digested(files.created(f"{root}/{name}{ending}.{attempt}"))
                sides.append((out, gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0)))
            return name, sides, tarfile.open(fileobj=sides[0][1], mode="w|", format=tarfile.PAX_FORMAT), [0, 0]

        def close() -> None:
            name, sides, tar, counts = open_
            tar.close()
            row = [*now, *counts]
            for (out, stream), ending in zip(sides, (".tar.gz", ".index.ndjson.gz")):
                stream.close()
                out.out.close()
                row += [f"{name}{ending}.{attempt}", f"{name}{ending}", out.size, out.sha256]
            done.append(row)

        for batch in batches:
            for who, number, base, key_, name, content, more in zip(*(c.to_pylist() for c in batch.columns)):
                if now is fresh or (who, number) != now:
                    if now is not fresh:
                        close()
                    now, open_ = (who, number), begin(base, number)
                info = tarfile.TarInfo(name)
                info.size, info.mode, info.mtime = len(content), 0o600, 0
                open_[2].addfile(info, io.BytesIO(content))
                line = {"key": key_, "path": name, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()} | json.loads(more)
                open_[1][1][1].write(json.dumps(line, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass") + b"\n")
                open_[3][0] += 1
                open_[3][1] += len(content)
        if now is not fresh:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.names)

    schema = T.StructType([objects.schema[resource]]).add("pack", "long").add("records", "long").add("source_bytes", "long")
    for side in ("", "index_"):
        schema = schema.add(f"{side}draft", "string").add(f"{side}path", "string").add(f"{side}size", "long").add(f"{side}sha256", "string")
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return _committed(written(members.mapInArrow(run, schema), "pack-drafts"), root, [("draft", "path"), ("index_draft", "index_path")])


def read_packs(packs: DataFrame, root: str, resource: str, with_body: bool = True) -> DataFrame:
    """The objects of packs, index and archive walked in step: resource, pack, key, size, sha256, told (the index line), body.

    ``packs``: resource, pack, path, index_path, and source_bytes, if it is there: a task reads
    many small packs then, and one is read a task else. A member that is not the one the index
    names next, that is no plain file, or whose size or digest is another, a missing and
    a further member fail the run with the key or the member's name. A pack is read as a
    stream; one member is held at a time.
    """
    root = root.rstrip("/")

    def walk(path: str, index_path: str) -> Iterator[tuple]:
        with files.opened(f"{root}/{index_path}") as a, gzip.GzipFile(fileobj=a) as index, files.opened(f"{root}/{path}") as b, tarfile.open(fileobj=b, mode="r|gz") as tar:
            for line in index:
                if not line.strip():
                    continue
                entry = json.loads(line)
                member = tar.next()
                if member is None:
                    raise ValueError(f"{path} ends before {entry['key']!r}")
                if member.name != entry["path"] or not member.isfile():
                    raise ValueError(f"{path} and its index differ at {entry['key']!r}: {member.name}")
                content = tar.extractfile(member).read()
                if len(content) != entry["size"] or hashlib.sha256(content).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{path}: the object {entry['key']!r} is damaged")
                yield entry["key"], entry["size"], entry["sha256"], line.decode().rstrip("\n"), content if with_body else None
            if (further := tar.next()) is not None:
                raise ValueError(f"{path} has a member its index does not name: {further.name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (number, path, index_path) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                held, size = [], 0
                for row in walk(path, index_path):
                    held.append((batch.column(0)[k].as_py(), number, *row))
                    size += row[1]
                    if size >= files.READ * 8 or len(held) >= 1000:
                        yield told(held)
                        held, size = [], 0
                if held:
                    yield told(held)

    def told(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema.names)

    schema = T.StructType([packs.schema[resource]]).add("pack", "long").add("key", "string").add("size", "long").add("sha256", "string").add("told", "string").add("body", "binary")
    kinds = [to_arrow_type(f.dataType) for f in schema]
    rows = packs.select(resource, "pack", "path", "index_path")
    held = packs.agg(F.count("*").alias("n"), (F.coalesce(F.sum("source_bytes"), F.lit(0)) if "source_bytes" in packs.columns else F.lit(None).cast("long")).alias("bytes")).first()
    most = 10_000 if held["bytes"] is None else max(tasks(packs.sparkSession), held["bytes"] // TASK_BYTES)
    out = rows.repartitionByRange(max(1, min(held["n"], most, 10_000)), "path").mapInArrow(run, schema)
    return out if with_body else out.drop("body")


def artifacts(packs: DataFrame, resource: str) -> DataFrame:
    """(resource, unit, kind, path, size, sha256): the two artifacts of each pack."""
    sides = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{p}path").alias("path"), F.col(f"{p}size").alias("size"), F.col(f"{p}sha256").alias("sha256")) for kind, p in (("data", ""), ("index", "index_"))])
    return packs.select(resource, F.col("pack").alias("unit"), F.explode(sides).alias("a")).select(resource, "unit", "a.*")
