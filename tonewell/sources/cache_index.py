"""An index over the files of a growing keyed table, so that a lookup opens few of them.

The table's rows carry ``sig``, the sha1 of their key in hex. Every append is a folder of
files that are sorted by it, and a small table with one row per file: the first and last
signature and a Bloom filter of all. A lookup finds in that table which files can hold
the wanted signatures. Compaction writes all rows into one sorted set of files and a
table for them; writing that table is the swap.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter per signature, and bits set for each: about one false hit in two thousand.
BITS, PROBES = 16, 11
ENTRY = "file string, low string, high string, rows bigint, bloom binary"
#: Hex digits by which files and signatures meet.
DIGITS = 3


def probes(sigs: list[str], bits: int) -> np.ndarray:
    """The places of each signature: its own digits are as good as hashes."""
    first = np.array([int(s[8:20], 16) for s in sigs], np.uint64)
    step = np.array([int(s[20:32], 16) | 1 for s in sigs], np.uint64)
    return (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(sigs: list[str]) -> bytes:
    """Filter of a set of signatures."""
    bits = max(64, -(-len(sigs) * BITS // 8) * 8)
    field = np.zeros(bits, bool)
    field[probes(sigs, bits).ravel().astype(np.int64)] = True
    return np.packbits(field).tobytes()


def held(filter_bytes: bytes, sigs: list[str]) -> np.ndarray:
    """Which signatures may be in the set."""
    field = np.unpackbits(np.frombuffer(filter_bytes, np.uint8)).astype(bool)
    return field[probes(sigs, len(field)).astype(np.int64)].all(1)


class SignedFiles:
    """The table in a folder: ``data`` holds the files, ``index`` their entries, one folder per change.

    One writer at a time; readers always see the last finished change.
    """

    def __init__(self, spark: SparkSession, folder: str, file_rows: int = 1_000_000):
        self.spark, self.folder, self.file_rows = spark, folder, file_rows

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def changes(self) -> list[str]:
        """Finished changes in order: ``<number>-add`` and ``<number>-base``."""
        path, fs = self._path("index")
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n for n in names if fs.exists(self._path("index", n, "_SUCCESS")[0])]

    def live(self) -> list[str]:
        """The changes that count: those from the last compaction on."""
        names = self.changes()
        bases = [i for i, n in enumerate(names) if n.endswith("-base")]
        return names[bases[-1] :] if bases else names

    def index(self) -> DataFrame | None:
        """Entries of all files that count, None before the first change."""
        names = self.live()
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.folder}/index/{n}" for n in names]) if names else None

    def _write(self, rows: DataFrame, kind: str) -> None:
        """Write ``rows`` as sorted files, then their entries: from then on they count."""
        names = self.changes()
        number = int(names[-1].split("-")[0]) + 1 if names else 0
        data = f"{self.folder}/data/{number:08d}-{uuid.uuid4().hex}"
        n = rows.count()
        if n:
            parts = rows.repartitionByRange(max(1, math.ceil(n / self.file_rows)), "sig").sortWithinPartitions("sig")
            parts.write.parquet(data)
            made = self.spark.read.parquet(data).select(F.col("_metadata.file_path").alias("file"), "sig")
            entries = made.groupBy("file").applyInPandas(_entry, ENTRY)
        else:
            entries = self.spark.createDataFrame([], ENTRY)
        entries.write.mode("overwrite").parquet(f"{self.folder}/index/{number:08d}-{kind}")

    def append(self, rows: DataFrame) -> None:
        """Add ``rows`` (sig, ...); they should be written or cheap, as they are read twice."""
        self._write(rows, "add")

    def files_with(self, wanted: DataFrame) -> list[str]:
        """Files that may hold one of the signatures (sig) of ``wanted``; only their names reach the driver."""
        index = self.index()
        if index is None:
            return []
        number = lambda c: F.conv(F.substring(c, 1, DIGITS), 16, 10).cast("int")
        spans = index.select(F.col("file").alias("of"), "low", "high", F.explode(F.sequence(number(F.col("low")), number(F.col("high")))).alias("cell"))
        asked = wanted.select("sig", number(F.col("sig")).alias("cell"))
        near = asked.join(spans, "cell").filter(F.col("sig").between(F.col("low"), F.col("high"))).select("sig", "of")

        def test(sigs: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
            if not len(sigs) or not len(entry) or not held(entry["bloom"].iloc[0], sigs["sig"].tolist()).any():
                return pd.DataFrame({"file": []}, dtype=object)
            return pd.DataFrame({"file": entry["file"].iloc[:1]})

        # a file's signatures, at most as many as are asked for in its range
        hits = near.groupBy("of").cogroup(index.select("file", "bloom").groupBy("file")).applyInPandas(test, "file string")
        return sorted(r["file"] for r in hits.collect())

    def read(self, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*files)

    def compact(self) -> None:
        """All rows in one sorted set of files, one row per signature; files of the compaction before go."""
        index = self.index()
        if index is None:
            return
        before = self.changes()
        files = [r["file"] for r in index.select("file").collect()]
        rows = self.read(files).dropDuplicates(["sig"]) if files else self.spark.createDataFrame([], "sig string")
        self._write(rows, "base")
        # what the last compaction but one had replaced is read by nobody any more
        bases = [n for n in before if n.endswith("-base")]
        if bases:
            self._drop([n for n in before if n < bases[-1]])

    def _drop(self, names: list[str]) -> None:
        for name in names:
            place, fs = self._path("index", name)
            data, _ = self._path("data")
            for status in fs.listStatus(data):
                if status.getPath().getName().startswith(f"{name.split('-')[0]}-"):
                    fs.delete(status.getPath(), True)
            fs.delete(place, True)


def _entry(rows: pd.DataFrame) -> pd.DataFrame:
    sigs = rows["sig"].tolist()
    values = (rows["file"].iloc[0], min(sigs), max(sigs), len(sigs), bloom(sigs))
    return pd.DataFrame([values], columns=[c.split()[0] for c in ENTRY.split(", ")])
