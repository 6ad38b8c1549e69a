import gzip
import hashlib
import io
import random
import zlib

import pytest

from lodestone.llm import queries
from lodestone.llm import warc_archive as wa
from lodestone.llm.shared import scratch_path


def expected(pages):
    """(page_id, bytes, digest, type, refers_to) of each page, by the rule."""
    keep = {}
    for page, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            keep[raw] = max(page, keep.get(raw, page))
    out = []
    for page, html in pages:
        raw = (html or "").encode()
        to = keep.get(raw) if len(raw) >= 1000 else None
        to = None if to == page else to
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    long, longer = "é<p>" * 300, "x" * 5000
    pages = [(1, "u1", long), (2, "u 2\n", long), (9, None, long), (3, "u3", longer), (4, "u4", None), (5, "u5", "short"), (6, "u6", "short"), (3, "u3", longer), (None, "n", longer), (7, "u7", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]
    frame = spark.createDataFrame([(a, b, c, 1) for a, b, c in pages], "page_id long, url string, html string, offset int").repartition(2)
    got = [tuple(r)[:5] for r in wa.round_trip(frame).collect()]
    assert sorted(got, key=str) == expected([(a, c) for a, _, c in pages])
    assert wa.round_trip(frame.limit(0)).count() == 0


def test_the_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    got = [tuple(r) for r in queries.op4_warc_normalise(spark, sf).collect()]
    assert sorted(got, key=str) == expected(pages)


def test_archives_are_normalised(spark):
    """One gzip stream before; after, one member a record at the offset in the sidecar, and the same records."""
    folder = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(k, f"u{k}", "page " * 400 * (k % 3)) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    listed = wa.write_archives(pages, folder, archive_bytes=20_000)
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    names = sorted({r["archive"] for r in listed.collect()})
    assert len(names) > 1
    done = wa.normalise(wa.decide(listed), folder).collect()
    assert sum(r["records"] for r in done) == 40
    for r in done:
        path = r["path"].removeprefix("file:")
        whole = open("/" + path.lstrip("/"), "rb").read()
        import json

        index = [json.loads(x) for x in open("/" + path.lstrip("/") + ".idx")]
        assert b"".join(whole[e["offset"] : e["offset"] + e["length"]] for e in index) == whole
        for e in index:
            member = zlib.decompressobj(31)
            text = member.decompress(whole[e["offset"] :])
            assert text.startswith(wa.VERSION) and e["id"].encode() in text
            assert len(whole[e["offset"] :]) - len(member.unused_data) == e["length"]


def test_a_damaged_archive_is_told():
    raw = wa.response(1, "u", b"x" * 100, "a:0")
    packed = gzip.compress(raw + raw)
    assert len(list(wa.records(io.BytesIO(packed)))) == 2
    with pytest.raises(ValueError, match="ends within"):
        list(wa.records(io.BytesIO(gzip.compress(raw + raw[:-10]))))


def test_a_payload_of_several_reads(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefé<> \n") for _ in range(2_500_000))
    pages = [(1, "u", long), (2, "v", long), (3, "w", long[:-1]), (4, "x", "tail")]
    assert len(long.encode()) > 2 * wa.READ
    got = [tuple(r)[:5] for r in wa.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == expected([(a, c) for a, _, c in pages])
