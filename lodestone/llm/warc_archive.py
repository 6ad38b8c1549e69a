"""WARC archives: one record a page, monolithic gzip normalised to one member a record.

1. ``write_archives``: each task writes its pages to archives of about
   ``ARCHIVE_BYTES``, each one gzip stream over all records, and returns a narrow
   row a record (archive, ordinal, page_id, digest, bytes).
2. ``decide``: of records with equal payloads of at least ``REVISIT_BYTES``
   bytes the one with the largest page_id stays a response, the others revisit it.
   Only digests that occur twice are joined back, salted.
3. ``normalise``: inflates each archive once as a stream, rewrites every record as
   a gzip member of its own (a revisit without its payload), and writes a sidecar
   index of offsets beside it.
4. ``read_archives``: reads each member by its offset in the sidecar.

Files are written in the shared folder through pyarrow's file systems. Every
attempt of a task writes files of its own name, and only the names that a
finished attempt returns are read on, so lost executors do no harm.

Defined results: null html is an empty payload; a null url gives no target
header; a null page_id is kept and never referred to; repeated pages (same id,
same payload) are all responses; of equal payloads with the largest page_id twice
both are responses; very long payloads are written and read whole, one at a time;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_path, spread_join, written

ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 1000
READ = 1 << 20
# The line ends and version of the format.
VERSION, EOL, END = b"WARC/1.1", b"\r\n", b"\r\n\r\n"


def _open(path: str, how: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if how == "w":
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_file(at) if how == "r" else system.open_input_stream(at, compression=None)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in headers.items()]
    return EOL.join([VERSION, *lines, b"Content-Length: %d" % len(block)]) + END + block + END


def response(page_id, url: str | None, payload: bytes, place: str) -> bytes:
    http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + END
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:record:{place}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    digest = hashlib.sha1(payload).digest()
    headers |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    return record(headers, http + payload)


def revisit(headers: dict[str, str], refers_to: int) -> bytes:
    kept = {k: v for k, v in headers.items() if k not in ("Content-Length", "WARC-Type", "Content-Type")}
    return record({"WARC-Type": "revisit"} | kept | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}, b"")


def parse(head: bytes) -> dict[str, str]:
    return dict(line.decode().split(": ", 1) for line in head.split(EOL)[1:])


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of a gzip stream, inflated as it is read."""
    inflate, held = zlib.decompressobj(31), bytearray()
    more = True
    while more or held:
        head = held.find(END)
        size = int(parse(bytes(held[:head]))["Content-Length"]) if head >= 0 else 0
        whole = head + len(END) + size + len(END)
        if head >= 0 and len(held) >= whole:
            raw = bytes(held[:whole])
            del held[:whole]
            yield parse(raw[:head]), raw[head + len(END) : -len(END)], raw
            continue
        if not more:
            raise ValueError("the archive ends within a record")
        part = stream.read(READ)
        more = bool(part)
        while part:
            held += inflate.decompress(part)
            part = inflate.unused_data
            if part:
                inflate = zlib.decompressobj(31)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, number, out, size, ordinal = "", 0, None, 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and size >= archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    out, number = None, number + 1
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}"
                    out, pack, size, ordinal = _open(f"{folder}/{name}.whole.warc.gz", "w"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.write(pack.compress(response(page_id, url, payload, f"{name}:{ordinal}")))
                rows.append((name, ordinal, page_id, hashlib.sha1(payload).hexdigest(), len(payload)))
                size, ordinal = size + len(payload), ordinal + 1
            if rows:
                a, b, c, d, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d), pa.array(e, pa.int64())], ["archive", "ordinal", "page_id", "digest", "bytes"])
        if out is not None:
            out.write(pack.flush())
            out.close()

    return pages.mapInArrow(run, "archive string, ordinal long, page_id long, digest string, bytes long")


def decide(listed: DataFrame) -> DataFrame:
    """``listed`` with refers_to: null for responses."""
    kept = listed.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    out = spread_join(listed, kept, "digest", "ordinal")
    return out.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("_keep") != F.col("page_id")), F.col("_keep"))).drop("_keep")


def archives(listed: DataFrame, name: str = "archive") -> int:
    return max(1, listed.agg(F.count_distinct(name)).first()[0])


def normalise(decided: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive; one row an archive: its name and its sidecar's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers = {r["ordinal"]: r["refers_to"] for r in found or []}
                path = f"{folder}/{name}-{attempt}.warc.gz"
                index, offset = [], 0
                with _open(f"{folder}/{name}.whole.warc.gz", "s") as whole, _open(path, "w") as out:
                    for k, (headers, _, raw) in enumerate(records(whole)):
                        to = refers.get(k)
                        member = gzip.compress(raw if to is None else revisit(headers, to), 6, mtime=0)
                        out.write(member)
                        index.append({"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"]})
                        offset += len(member)
                with _open(path + ".idx", "w") as side:
                    side.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    revisits = decided.groupBy("archive").agg(F.collect_list(F.when(F.col("refers_to").isNotNull(), F.struct("ordinal", "refers_to"))).alias("refers"))
    # An archive is a task's work; names are dealt evenly, and their number grows with the pages.
    return revisits.repartitionByRange(archives(decided), "archive").mapInArrow(run, "path string, records long, bytes long")


def read_archives(written_: DataFrame) -> DataFrame:
    """One row a record, read by the offsets in the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path + ".idx", "r") as side:
                    index = [json.loads(line) for line in side.read().splitlines()]
                rows = []
                with _open(path, "r") as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        raw = gzip.decompress(f.read(entry["length"]))
                        head = raw.index(END)
                        h, block = parse(raw[:head]), raw[head + len(END) : -len(END)]
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if h["WARC-Type"] == "response":
                            payload = block[block.index(END) + len(END) :]
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the record at {entry['offset']} is damaged")
                        page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(to) if to else None, h.get("WARC-Target-URI"), path.rsplit("/", 1)[1], entry["offset"]))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive", "offset"])

    return written_.select("path").repartitionByRange(archives(written_, "path"), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, offset long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write, normalise and read back all of ``pages``; one row a record."""
    folder = scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    listed = written(write_archives(rows, folder), "warc-records")
    return read_archives(written(normalise(decide(listed), folder), "warc-archives"))
