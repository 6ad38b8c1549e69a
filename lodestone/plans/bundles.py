"""Queries that write artifacts and read them back: chunks, packs, the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, reuse
from ..operators.scratch import folder, written
from ..sources import archives, artifacts, files, ledger
from ..streaming import resume
from ..streaming.capture import definition
from .registry import query, table

CAP, OBJECTS = 20_000, 9

# The lines of a document's record, and the packs that greedy chunks of them make.
_LINE = """'{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '","digest":"' || md5(text) || '","n":' || strlen(text) || '}'"""
_CHUNKS = """WITH RECURSIVE d AS (SELECT source, doc_id, line, (strlen(line) + 1)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM (SELECT *, {line} AS line FROM documents)),
    p AS (SELECT source, rn, n AS held, 1::BIGINT AS cnt, 1::BIGINT AS part FROM d WHERE rn = 1
    UNION ALL SELECT d.source, d.rn, CASE WHEN {full} THEN d.n ELSE p.held + d.n END, CASE WHEN {full} THEN 1 ELSE p.cnt + 1 END, CASE WHEN {full} THEN p.part + 1 ELSE p.part END
    FROM p JOIN d ON d.source = p.source AND d.rn = p.rn + 1), c AS (SELECT d.*, p.part FROM d JOIN p USING (source, rn))"""
_PARTS = _CHUNKS.format(line=_LINE, full="p.held + d.n > 2000")


def _lines(spark, sf_dir):
    line = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), F.coalesce("lang", F.lit("")), F.lit('","digest":"'), F.md5("text"), F.lit('","n":'), F.octet_length("text").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", line.alias("line"))


@query(f"{_PARTS} SELECT source, part, left(sha256(source), 32) || '/part-' || printf('%06d', part) || '.ndjson' AS path, count(*) AS records, sum(n)::BIGINT AS source_bytes, sum(n)::BIGINT AS size, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256 FROM c GROUP BY source, part")
def snk2_part_descriptors(spark, sf_dir):
    """Part files cut at record boundaries: the descriptor of each, its digest the file's own."""
    made = artifacts.write_parts(_lines(spark, sf_dir), folder(spark, "parts"), "source", ["doc_id"], "line", 2000, compressed=False)
    return made.select("source", "part", "path", "records", "source_bytes", "size", "sha256")


@query(f"{_PARTS} SELECT source, part, (row_number() OVER (PARTITION BY source, part ORDER BY doc_id))::BIGINT AS place, line FROM c")
def snk2_parts_read_back(spark, sf_dir):
    """The lines of compressed part files, in their order within each file."""
    root = folder(spark, "parts-gz")
    made = artifacts.write_parts(_lines(spark, sf_dir), root, "source", ["doc_id"], "line", 2000)
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("base"))
    # A part has 2000 bytes of lines, so its lines are one bounded group; their own order is that of doc_id.
    listed = lines.groupBy("base", "file").agg(F.array_sort(F.collect_list(F.struct(F.get_json_object("value", "$.doc_id").cast("long").alias("k"), F.col("value").alias("line")))).alias("all"))
    both = made.withColumn("base", F.element_at(F.split("path", "/"), 1)).withColumn("file", F.element_at(F.split("path", "/"), 2)).join(listed, ["base", "file"])
    return both.select("source", "part", F.posexplode("all").alias("at", "x")).select("source", "part", (F.col("at") + 1).cast("long").alias("place"), "x.line")


@query(f"WITH d AS (SELECT doc_id, {_LINE} AS line FROM documents), r AS (SELECT *, row_number() OVER w AS rn, sum(strlen(line) + 1) OVER w AS running FROM d WINDOW w AS (ORDER BY doc_id)), k AS (SELECT * FROM r WHERE rn <= 400 AND running <= 30000) SELECT count(*) AS records, max(running)::BIGINT AS size, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256, (SELECT count(*) FROM d) > count(*) AS truncated FROM k")
def snk1_bounded_file(spark, sf_dir):
    """One file of the leading lines within a count and a sum of bytes; it says that lines were left out."""
    made = artifacts.write_bounded(_lines(spark, sf_dir).select("doc_id", "line"), folder(spark, "bounded"), ["doc_id"], "line", 400, 30_000)
    return made.select("records", "size", "sha256", "truncated")


def _objects(spark, sf_dir, changed: bool = False):
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if changed else F.col("text")
    # Some texts hold access keys, which no pack may: without these capitals nothing looks like one.
    # One capital at a time, on bytes: several times as fast as ``translate``, which goes by characters.
    safe = body
    for capital in "AKIS":
        safe = F.replace(safe, F.lit(capital), F.lit(capital.lower()))
    return docs.select("source", F.format_string("%012d", "doc_id").alias("key"), safe.alias("body"), "lang", "n_chars")


_BODY = "translate({body}, 'AKIS', 'akis')"
_PACKS = _CHUNKS.format(line=_BODY.format(body="text"), full=f"p.held + d.n > {CAP} OR p.cnt >= {OBJECTS}").replace("(strlen(line) + 1)::BIGINT AS n", "strlen(line)::BIGINT AS n")


@query(f"{_PACKS} SELECT source, part AS pack, count(*) AS records, sum(n)::BIGINT AS source_bytes, left(sha256(source), 32) || '/pack-' || printf('%06d', part) || '.tar.gz' AS path, left(sha256(source), 32) || '/pack-' || printf('%06d', part) || '.index.ndjson.gz' AS index_path FROM c GROUP BY source, part")
def snk3_packs_with_index(spark, sf_dir):
    """tar.gz packs by bytes and count, each with its index."""
    made = artifacts.write_packs(_objects(spark, sf_dir), folder(spark, "packs"), "source", "key", "body", ["lang", "n_chars"], CAP, OBJECTS)
    return made.select("source", "pack", "records", "source_bytes", "path", "index_path")


@query(
    f"{_PACKS} SELECT source, part AS pack, printf('%012d', doc_id) AS key, n AS size, sha256(line) AS sha256, md5(line) AS body_md5, lang, n_chars, sha256(encode(source) || unhex('00') || encode(printf('%012d', doc_id))) || '.bin' AS member FROM c JOIN (SELECT doc_id, lang, n_chars FROM documents) USING (doc_id)"
)
def src20_lockstep(spark, sf_dir):
    """Packs read back, index and archive in step."""
    root = folder(spark, "packs")
    made = artifacts.write_packs(_objects(spark, sf_dir), root, "source", "key", "body", ["lang", "n_chars"], CAP, OBJECTS)
    back = artifacts.read_packs(made, root, "source")
    told = lambda name: F.get_json_object("told", f"$.{name}")
    return back.select("source", "pack", "key", "size", "sha256", F.md5("body").alias("body_md5"), told("lang").alias("lang"), told("n_chars").cast("long").alias("n_chars"), told("path").alias("member"))


def _freshness(objects, packs_read):
    """kind, digest, records, bytes of each pack, as of the objects in it."""
    entries = packs_read.select("source", "pack", "key").join(objects.select("source", "key", F.md5("body").alias("etag"), F.octet_length("body").cast("bigint").alias("size"), F.md5("lang").alias("metadata_digest")), ["source", "key"])
    fresh = compare.pack_freshness(entries.withColumn("unit", F.concat_ws("/", "source", F.col("pack").cast("string"))), ["unit"])
    return fresh


def _unit(packs):
    return packs.withColumn("unit", F.concat_ws("/", "source", F.col("pack").cast("string")))


_FRESH = """SELECT source || '/' || part AS unit, sha256(string_agg(sha256(printf('%012d', doc_id)) || chr(0) || sha256(md5(b) || chr(0) || strlen(b) || chr(0) || md5(lang)) || chr(10), '' ORDER BY doc_id)) AS digest, sum(strlen(b)) AS bytes, min(part) AS part, min(source) AS source
    FROM (SELECT c.source, c.part, c.doc_id, lang, {body} AS b FROM c JOIN (SELECT doc_id, lang, text FROM documents) USING (doc_id)) GROUP BY 1"""


@query(
    f"{_PACKS}, old AS ({_FRESH.format(body=_BODY.format(body='text'))}), new AS ({_FRESH.format(body=_BODY.format(body='''(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END)'''))}), "
    "ends AS (SELECT min(source) AS lo, max(source) AS hi FROM documents), "
    "r AS (SELECT new.unit, CASE WHEN old.digest <> new.digest OR old.bytes <> new.bytes THEN 'source_content_changed' WHEN new.source = lo AND new.part % 2 = 1 THEN 'artifact_missing' WHEN new.source = hi AND new.part % 2 = 1 THEN 'artifact_corrupt' ELSE 'reused' END AS reason FROM new JOIN old USING (unit), ends) "
    "SELECT unit, CASE WHEN reason = 'reused' THEN 'reused' ELSE 'refreshed' END AS outcome, reason FROM r"
)
def joi2_ledger_decision(spark, sf_dir):
    """Reuse decided from the ledger: packs admitted and published, blobs then lost and damaged, bodies changed."""
    root, store = folder(spark, "packs"), folder(spark, "ledger")
    before, now = _objects(spark, sf_dir), _objects(spark, sf_dir, True)
    made = artifacts.write_packs(before, root, "source", "key", "body", ["lang"], CAP, OBJECTS)
    # Written, as it is used twice and the packs are to be read once.
    listed = written(artifacts.read_packs(made, root, "source", with_body=False).select("source", "pack", "key"), "listed")
    units = _freshness(before, listed).withColumn("kind", F.lit(reuse.PROVEN)).withColumn("outcome", F.lit("refreshed")).withColumn("reason", F.lit("no_candidate"))
    parts = _unit(artifacts.artifacts(made, "source").withColumnRenamed("unit", "pack")).select("source", "pack", "unit", "kind", "path", "sha256", "size")
    ledger.publish(units, parts.drop("source", "pack"), root, store, "documents", "first")

    ends = made.agg(F.min("source").alias("lo"), F.max("source").alias("hi")).first()
    hurt = parts.where((F.col("pack") % 2 == 1) & (F.col("kind") == "data") & F.col("source").isin(ends["lo"], ends["hi"]))

    def harm(rows) -> None:
        for r in rows:
            path = ledger.blob_path(store, r["sha256"])
            files.removed(path)
            if r["source"] != ends["lo"]:
                with files.created(path) as f:
                    f.write(b"damaged")

    hurt.foreachPartition(harm)
    old_units, old_parts, _ = ledger.load(spark, store, "documents")
    current = _freshness(now, listed).withColumn("kind", F.lit(reuse.PROVEN))
    return reuse.decide(current, ledger.candidates(old_units, old_parts, store)).select("unit", "outcome", "reason")


@query(f"{_PACKS} SELECT source || '/' || part AS unit, 'materialised' AS state, sum(n)::BIGINT AS body_bytes FROM c GROUP BY 1")
def snk8_materialised(spark, sf_dir):
    """Packs brought back from the ledger's blobs into an empty folder, verified, and read there."""
    root, store, fresh = folder(spark, "packs"), folder(spark, "ledger"), folder(spark, "restored")
    made = artifacts.write_packs(_objects(spark, sf_dir), root, "source", "key", "body", None, CAP, OBJECTS)
    parts = _unit(artifacts.artifacts(made, "source").withColumnRenamed("unit", "pack")).select("unit", "kind", "path", "sha256", "size")
    ledger.publish(parts.select("unit").distinct(), parts, root, store, "documents", "first")
    _, old_parts, _ = ledger.load(spark, store, "documents")
    told = ledger.materialised(old_parts, store, fresh)
    state = told.groupBy("unit").agg(F.coalesce(F.max("problem"), F.lit("materialised")).alias("state"))
    back = _unit(artifacts.read_packs(made, fresh, "source", with_body=False)).groupBy("unit").agg(F.sum("size").alias("body_bytes"))
    return state.join(back, "unit")


@query(f"{_PACKS} SELECT source AS resource, part AS pack, count(*) AS records, sum(n)::BIGINT AS source_bytes, left(sha256(source), 32) || '/pack-' || printf('%06d', part) || '.tar.gz' AS path FROM c GROUP BY source, part")
def str2_resumed_packs(spark, sf_dir):
    """An inventory taken in two stopped runs, then packs in two: what an unstopped run makes."""
    landing, state, root = folder(spark, "landing"), folder(spark, "resume-state"), folder(spark, "packs")
    objects = _objects(spark, sf_dir)
    objects.repartition(6).write.parquet(landing)
    landed, wanted = spark.read.parquet(landing), definition("documents", {"packs": [CAP, OBJECTS]})
    enter = lambda most: resume.take_inventory(spark, landing, objects.schema, state, wanted, "source", "key", "body", files_at_once=2, most_batches=most)
    enter(1)
    enter(None)
    write = lambda most: resume.write_rest(spark, landed, root, state, wanted, "source", "key", "body", ["lang"], CAP, OBJECTS, packs_a_round=50, most_rounds=most)
    write(1)
    return write(None).select("resource", "pack", "records", "source_bytes", "path")


@query(
    """WITH d AS (SELECT source AS resource, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), p AS (SELECT resource, (rn - 1) // 9 + 1 AS pack, count(*) AS n, sum(size) AS bytes FROM d GROUP BY ALL)
    SELECT problem, n FROM (SELECT 'batch_gap' AS problem, 1::BIGINT AS n UNION ALL SELECT 'batch_records', 1 UNION ALL SELECT 'repeated_key', count(*) FROM d WHERE doc_id % 97 = 0 UNION ALL SELECT 'negative_size', count(*) FILTER (doc_id % 89 = 0) + count(*) FILTER (doc_id % 89 = 0 AND doc_id % 97 = 0) FROM d
    UNION ALL SELECT 'plan_differs', count(*) FILTER (doc_id % 97 = 0 AND doc_id % 89 <> 0) + 2 * count(*) FILTER (doc_id % 89 = 0) FROM d UNION ALL SELECT 'pack_over', count(*) FROM p WHERE n > 1 AND bytes > 20000
    UNION ALL SELECT 'done_twice', count(*) FROM p WHERE pack = 2 UNION ALL SELECT 'done_unknown', count(DISTINCT resource) FROM d UNION ALL SELECT 'done_differs', count(*) FROM p WHERE pack = 3) WHERE n > 0"""
)
def str4_state_problems(spark, sf_dir):
    """A resume state with faults of each kind: how often each is found."""
    from ..operators.packing import pack

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("resource"), F.format_string("%012d", "doc_id").alias("key"), F.md5("text").alias("etag"), F.octet_length("text").cast("long").alias("size"), "doc_id")
    # Batches 0, 1 and 3 are noted; of batch 3 one entry too many.
    placed = docs.withColumn("batch", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (F.col("doc_id") % 3 + 1).cast("int")).cast("long"))
    entered = placed.unionAll(placed.where("doc_id % 97 = 0")).withColumn("size", F.when(F.col("doc_id") % 89 == 0, -1).otherwise(F.col("size")))
    noted = entered.groupBy("batch").agg(F.count("*").alias("records")).withColumn("records", F.when(F.col("batch") == 3, F.col("records") - 1).otherwise(F.col("records")))
    planned = pack(docs, "resource", ["key"], "size", 1 << 50, 9, carried=["etag"])
    packs = planned.groupBy("resource", "pack").agg(F.count("*").alias("records"), F.sum("size").alias("source_bytes"))
    written = packs.unionAll(packs.where("pack = 2")).unionAll(packs.where("pack = 1").withColumn("pack", F.lit(10**6).cast("long"))).withColumn("records", F.when(F.col("pack") == 3, 0).otherwise(F.col("records")))
    return resume.problems(entered.drop("doc_id"), noted, planned, written, 20_000, 9)


@query(f"{_PARTS} SELECT left(sha256(source), 32) || '/part-' || printf('%06d', part) || '.ndjson' AS path, sum(n)::BIGINT AS size, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256 FROM c GROUP BY source, part")
def snk6_archive_roundtrip(spark, sf_dir):
    """Part files put into one archive and taken out of it: every file as its descriptor says."""
    root, fresh = folder(spark, "parts"), folder(spark, "unpacked")
    made = artifacts.write_parts(_lines(spark, sf_dir), root, "source", ["doc_id"], "line", 2000, compressed=False)
    archive = f"{folder(spark, 'archive')}/bundle.tar.gz"
    archives.write_archive(made, root, archive)
    return archives.read_archive(spark, archive, made, fresh)
