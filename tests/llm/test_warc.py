import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tonewell.llm import warc_chunks
from tonewell.session import scratch_path

PAGES = "page_id long, url string, html string, archive string, record_no long, refers_to long"


def rows():
    rng = random.Random(3)
    big = "".join(rng.choice("<p>éab\r\n ") for _ in range(300_000))
    same = "<html>" + "same " * 40 + "</html>"
    pages = [(5, "http://x\r\ny", same), (3, None, same), (9, "u", same), (4, "u", "tiny"), (2, "u", "tiny"), (1, "u", None)]
    pages += [(6, "u", ""), (7, "u", big), (8, "u", big), (10, "u", "WARC/1.1\r\n\r\nx" * 20), (None, "u", same), (11, "u", same), (11, "u", same)]
    return [(*p, "x", 1, 2) for p in pages]


def brute(pages):
    first = {}
    for i, _, html, *_ in pages:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html, *_ in pages:
        body = (html or "").encode()
        refers = first.get(body) if first.get(body) != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), PAGES).repartition(3)
    out = warc_chunks.round_trip(spark, pages)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows())


def test_empty(spark):
    assert warc_chunks.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []


@pytest.fixture
def manifest(spark):
    pages = spark.createDataFrame(rows(), PAGES).coalesce(1)
    folder = f"file://{scratch_path(spark, 'warc')}"
    return warc_chunks.write_archives(warc_chunks.with_revisits(pages, F.col("page_id"), F.col("html")), folder)


def test_chunks_are_bounded_and_whole(spark, manifest):
    chunks = warc_chunks.read_chunks(manifest, chunk_bytes=10_000, slice_bytes=777).collect()
    payloads = {r[0]: (r[2] or "").encode() for r in rows()}
    records = {}
    for c in sorted(chunks, key=lambda c: c["chunk_no"]):
        assert len(c["data"]) <= 10_000
        body = records.setdefault(c["record_no"], [c["record_id"], c["record_type"], b""])
        body[2] += c["data"]
        assert hashlib.sha256(body[2]).hexdigest() == c["running_digest"]
    assert max(c["chunk_no"] for c in chunks) >= 20
    for name, kind, body in records.values():
        key = name.split(":")[-1].strip(">")
        assert body == (b"" if kind == "revisit" else payloads[None if key == "null" else int(key)])


def test_archives_are_plain_warc(manifest):
    name = manifest.first()["archive"].removeprefix("file://")
    with gzip.open(name) as f:
        data = f.read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        size = int(re.search(rb"Content-Length: (\d+)", data[at:end])[1])
        assert data[at:end].startswith(b"WARC/1.1\r\n")
        at = end + 4 + size
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4


def test_damage_is_noticed(spark, manifest):
    chunks = warc_chunks.read_chunks(manifest).withColumn("running_digest", F.lit("0"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc_chunks.page_records(chunks).collect()
