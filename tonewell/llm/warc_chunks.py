"""WARC archives written and read by tasks; payloads read back as a table of bounded chunks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.llm.common import written
from tonewell.session import scratch_path

ARCHIVE = "archive string, records long, archive_bytes long"
CHUNK = (
    "archive string, record_no long, record_id string, record_type string, uri string, refers_to string, "
    "stated_digest string, chunk_no int, is_last boolean, data binary, running_digest string"
)
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 100


def with_revisits(pages: DataFrame, key: Column, payload: Column, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` with ``__key``, ``__payload``, ``__digest`` and ``__refers`` (the key of the first copy, or null).

    Digests that occur once never meet the join. The table of the others is written
    first, so that its real size decides between a broadcast and a shuffle join;
    a payload that holds a third of the rows is one partial sum per task in the
    aggregate and a split partition in the join.
    """
    rows = pages.select(
        key.cast("long").alias("__key"), F.coalesce(payload, F.lit("")).alias("__payload"), F.col("url").alias("__url")
    )
    digest = F.sha2(F.encode("__payload", "UTF-8"), 256)
    rows = rows.withColumn("__digest", digest)
    firsts = written(
        rows.filter(F.octet_length("__payload") >= least)
        .groupBy(F.col("__digest").alias("__same"))
        .agg(F.min("__key").alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1")
        .drop("__n"),
        "firsts",
    )
    joined = rows.join(firsts, rows["__digest"] == firsts["__same"], "left").drop("__same")
    refers = F.when(~F.col("__key").eqNullSafe(F.col("__first")), F.col("__first"))
    return joined.withColumn("__refers", refers).drop("__first")


def record_id(key) -> str:
    return f"<urn:page:{'null' if key is None or pd.isna(key) else int(key)}>"


def write_archives(rows: DataFrame, folder: str, slice_bytes: int = 1 << 20) -> DataFrame:
    """Write one record-compressed archive per task; the manifest names those of tasks that ended well.

    A payload is compressed in slices. A revisit holds no payload, only the digest
    and the record it refers to. A repeated task writes another file, and the one that
    its first attempt left is in no manifest.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        fs, path = FileSystem.from_uri(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        records = size = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for key, url, payload, digest, refers in batch[
                    ["__key", "__url", "__payload", "__digest", "__refers"]
                ].itertuples(index=False, name=None):
                    body = b"" if not pd.isna(refers) else payload.encode()
                    kind = "response" if pd.isna(refers) else "revisit"
                    head = [
                        "WARC/1.1",
                        f"WARC-Type: {kind}",
                        f"WARC-Record-ID: {record_id(key)}",
                        "WARC-Date: 1970-01-01T00:00:00Z",
                        f"WARC-Target-URI: {' '.join((url or '').split())}",
                        f"WARC-Payload-Digest: sha256:{digest}",
                        "Content-Type: text/html",
                        f"Content-Length: {len(body)}",
                    ]
                    if kind == "revisit":
                        head.insert(6, f"WARC-Refers-To: {record_id(refers)}")
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += out.write(packer.compress(("\r\n".join(head) + "\r\n\r\n").encode()))
                    view = memoryview(body)
                    for at in range(0, len(body), slice_bytes):
                        size += out.write(packer.compress(view[at : at + slice_bytes]))
                    size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
        yield pd.DataFrame({"archive": [name], "records": [records], "archive_bytes": [size]})

    named = rows.withColumns({c: F.col(c).cast("string") for c in ("__key", "__refers")})
    return written(named.mapInPandas(write, ARCHIVE), "manifest")


class Unpacked:
    """Bytes of concatenated compressed members, read on demand in bounded slices."""

    def __init__(self, stream, slice_bytes: int):
        self.stream, self.slice = stream, slice_bytes
        self.member = zlib.decompressobj(31)
        self.raw, self.buffer, self.ended = b"", bytearray(), False

    def _more(self) -> bool:
        while not self.ended:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.slice)
                if not self.raw:
                    self.ended = True
                    break
            got = self.member.decompress(self.raw, self.slice)
            self.raw = self.member.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``; None at the end of the archive."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        got = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return got

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self._more():
            pass
        got = bytes(self.buffer[:most])
        del self.buffer[:most]
        return got


def read_chunks(manifest: DataFrame, chunk_bytes: int = 1 << 20, slice_bytes: int = 1 << 16) -> DataFrame:
    """The archives as rows of at most ``chunk_bytes``: record identifier, chunk number, data.

    ``running_digest`` is the SHA-256 of the record's payload up to and including the
    chunk, so the last chunk carries the payload's own. Never more than one chunk and
    one slice of an archive is in memory. An empty payload is one empty chunk.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        names = [c.split()[0] for c in CHUNK.split(", ")]
        for batch in batches:
            for name in batch["archive"]:
                fs, path = FileSystem.from_uri(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    source, record_no, held, held_bytes = Unpacked(stream, slice_bytes), 0, [], 0
                    while (head := source.until(b"\r\n\r\n")) is not None:
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
                        left, digest, chunk_no = int(fields["Content-Length"]), sha256(), 0
                        common = (
                            name, record_no, fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"),
                            fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        )
                        while True:
                            data = source.take(min(left, chunk_bytes))
                            left -= len(data)
                            if left and not data:
                                raise ValueError(f"{name}: record {record_no} ends early")
                            digest.update(data)
                            held.append((*common, chunk_no, left == 0, data, digest.hexdigest()))
                            held_bytes += len(data)
                            chunk_no += 1
                            if held_bytes >= 4 * chunk_bytes or len(held) >= 500:
                                yield pd.DataFrame(held, columns=names)
                                held, held_bytes = [], 0
                            if not left:
                                break
                        source.take(4)
                        record_no += 1
                    if held:
                        yield pd.DataFrame(held, columns=names)

    # the manifest is one small file: deal its archives out to tasks
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(parts).mapInPandas(read, CHUNK)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks; a revisit takes size and digest of the response it refers to."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as bigint)")
    records = (
        chunks.select(
            "archive", "record_no", "chunk_no", "record_id", "record_type", "refers_to", "stated_digest",
            F.octet_length("data").cast("long").alias("n"), "running_digest",
        )
        .groupBy("archive", "record_no")
        .agg(
            F.first("record_id").alias("record_id"),
            F.first("record_type").alias("record_type"),
            F.first("refers_to").alias("refers_to"),
            F.first("stated_digest").alias("stated_digest"),
            F.sum("n").alias("own_bytes"),
            F.max_by("running_digest", "chunk_no").alias("own_digest"),
        )
        .select(
            number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "record_type",
            "own_bytes", "own_digest", "stated_digest",
        )
    )
    records = written(records, "records")
    damaged = (F.col("record_type") == "response") & (F.col("own_digest") != F.col("stated_digest"))
    records = records.withColumn(
        "own_digest", F.when(damaged, F.raise_error(F.lit("payload differs from its digest"))).otherwise(F.col("own_digest"))
    )
    revisits = records.filter("record_type = 'revisit'")
    responses = records.filter("record_type = 'response'")
    targets = (
        responses.join(revisits.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy("page_id", "own_digest")
        .agg(F.first("own_bytes").alias("target_bytes"))
        .select(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("stated_digest"), "target_bytes")
    )
    resolved = revisits.join(targets, ["refers_to", "stated_digest"])
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    own = responses.withColumnsRenamed({"own_bytes": "payload_bytes", "own_digest": "payload_digest"})
    other = resolved.withColumnsRenamed({"target_bytes": "payload_bytes", "stated_digest": "payload_digest"})
    return own.select(*columns).union(other.select(*columns))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and read the archives back, a row per page.

    Null html is an empty payload, a null url an empty address, a null page_id the
    record ``<urn:page:null>`` that nothing refers to. Rows that repeat the smallest
    page_id of their payload are all responses. An empty table gives empty archives
    and no row. Other columns are ignored.
    """
    folder = scratch_path(spark, "warc")
    if "://" not in folder:
        folder = f"file://{folder}"
    manifest = write_archives(with_revisits(pages, F.col("page_id"), F.col("html")), folder)
    return page_records(read_chunks(manifest))
