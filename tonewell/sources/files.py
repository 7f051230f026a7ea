"""Single files from tasks: whole contents by name, byte ranges of large ones.

Spark's writers choose their own file names, its binary source reads a file as a whole
and its file index holds every name on the driver. Where a file must have a name, only a
part of it is wanted, or a folder may hold millions, tasks go to the store themselves, by
the path's scheme.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.session import scratch_path

#: Entries after which a walk leaves unopened folders to another round, and rows handed on together.
ENTRIES, LISTED = 10_000, 10_000
LISTING = "place string, path string, changed bigint, length bigint, unopened boolean"
# What Java's URI writes as bytes in hexadecimal: spaces, controls, and ASCII that no path may hold.
QUOTED = re.compile("[\\x00-\\x20\"#%<>?\\[\\\\\\]^`{|}\\x7f-\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def file_path() -> Column:
    """Path of the read file, without the local scheme."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")


def local_name(path: str) -> str:
    """A path as ``file_path`` names what lies below it: without the local scheme."""
    return re.sub("^file:(//)?", "", path)


def store_of(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


def dealt(files: DataFrame, name: str = "path") -> DataFrame:
    """File names over all shuffle partitions: rows are small here, what tasks read for them is not.

    The number is given, as Spark would join partitions of few bytes to a single task.
    """
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, bytes, milliseconds of its last change) of what a folder holds; links are followed.

    A local folder is read entry by entry, one of another store is a list in its task.
    """
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    fs, place = store_of(_uri(folder))
    if not isinstance(fs, LocalFileSystem):
        for info in fs.get_file_info(FileSelector(place)):
            yield info.base_name, info.type == FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(place) as entries:
        for entry in entries:
            try:
                entry.name.encode()
                state = entry.stat()
                yield entry.name, entry.is_dir(), state.st_size, state.st_mtime_ns // 1_000_000
            except (OSError, UnicodeEncodeError):  # a link to nothing, or a name that is no text: Spark lists neither
                continue


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file index leaves out."""
    marked = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if name.startswith(("_metadata", "_common_metadata")):
        return marked and not folder
    return marked or name.endswith("._COPYING_")


def _quoted(place: str) -> str:
    """A plain name as ``file_path`` has it."""
    return QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), place)


def _uri(place: str) -> str:
    """What ``store_of`` takes: a local name is plain, a URI is quoted."""
    return place if place.startswith("/") else _quoted(place)


def _walk(root: str, limit: int) -> Iterator[tuple]:
    """Rows of ``LISTING``: the files below a folder, and after ``limit`` entries the folders left to another round."""
    waiting, seen = deque([root]), 0
    while waiting and seen < limit:
        parent = waiting.popleft()
        for name, folder, length, changed in _entries(parent):
            seen += 1
            path = f"{parent.rstrip('/')}/{name}"
            if _hidden(name, folder):
                continue
            if not folder and length > 0:
                yield path, _quoted(path), changed, length, False
            elif folder and seen < limit:
                waiting.append(path)
            elif folder:
                yield path, None, None, None, True
    yield from ((path, None, None, None, True) for path in waiting)


def _roots(spark: SparkSession, root: str) -> list:
    """Hadoop's state of the path, or of all that match it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.globStatus(fs.makeQualified(path)) or [])


def _reached(place: str) -> bool:
    try:
        store_of(_uri(place))
    except Exception:
        return False
    return True


def name_matches(spark: SparkSession, pattern: str) -> Column:
    """Hadoop's pattern matches the name of a file of ``list_files``."""
    text = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return F.substring_index("place", "/", -1).rlike(f"\\A(?s:{text})\\z")


def _content(place: str) -> bytes:
    with Ranges(_uri(place)) as source:
        return source.read(0, source.size)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modificationTime, length, place, content)`` of the files that Spark's binary source lists below ``root``.

    ``root`` may have wildcards. Hidden and empty files are left out. Tasks walk the folders
    in rounds and write what they find to the shared folder, so that the driver holds
    neither files nor folders; a tree of fewer than ``ENTRIES`` entries is one round. The
    listing is that of the call, ``content`` is only read where it is selected. ``place``
    is the plain name, ``path`` that of ``file_path``.
    """
    found = _roots(spark, root)
    places = [local_name(state.getPath().toString()) for state in found]
    if not places or not all(map(_reached, places)):
        # Spark's own error for a path that is not there, and its index for stores that only Spark knows
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return files.withColumns({"path": file_path(), "place": F.col("path")})

    limit, names = ENTRIES, [c.split()[0] for c in LISTING.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for root in batch["place"] for row in _walk(root, limit))
        while part := list(islice(rows, LISTED)):
            made = pd.DataFrame(part, columns=names)
            yield made.astype({"changed": "Int64", "length": "Int64"})

    folders = [(place,) for place, state in zip(places, found, strict=True) if state.isDirectory()]
    single = [
        (place, _quoted(place), state.getModificationTime(), state.getLen(), False)
        for place, state in zip(places, found, strict=True)
        if not state.isDirectory() and state.getLen() > 0 and not _hidden(place.rsplit("/", 1)[-1], False)
    ]
    folder, turn = scratch_path(spark, "listing"), 0
    left = spark.createDataFrame(folders, "place string").coalesce(max(1, len(folders)))
    while turn == 0 or not left.isEmpty():
        rows = left.mapInPandas(walk, LISTING) if turn == 0 else dealt(left, "place").mapInPandas(walk, LISTING)
        rows = rows.unionByName(spark.createDataFrame(single, LISTING)) if turn == 0 and single else rows
        rows.write.parquet(f"{folder}/turn={turn}")
        left = spark.read.schema(LISTING).parquet(f"{folder}/turn={turn}").filter("unopened").select("place")
        turn += 1
    files = spark.read.schema(f"{LISTING}, turn int").parquet(folder).filter("NOT unopened")
    if len(places) > 1:  # one of them may lie below another
        files = files.dropDuplicates(["place"])
    changed, content = F.timestamp_millis("changed"), F.udf(_content, "binary", useArrow=False)
    # dealt by name, the contents are read after that
    files = dealt(files.select("path", changed.alias("modificationTime"), "length", "place"))
    return files.withColumn("content", content("place"))


def replace_file(path: str, pieces: Iterator[bytes]) -> int:
    """Write a file under a name of this attempt and move it to its own; returns its bytes.

    A task that is lost halfway leaves no file under ``path``, a repeated one the same file;
    pieces that fail leave none at all.
    """
    fs, place = store_of(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    folder, name = place.rsplit("/", 1)
    made = f"{folder}/_attempt-{TaskContext.get().taskAttemptId()}-{name}"
    size = 0
    try:
        with fs.open_output_stream(made, compression=None) as out:
            for piece in pieces:
                size += out.write(piece)
    except Exception:
        fs.delete_file(made)
        raise
    fs.move(made, place)
    return size


class Ranges:
    """A file of a store, read by byte ranges; ``size`` is its length."""

    def __init__(self, path: str):
        fs, place = store_of(path)
        self.source = fs.open_input_file(place)
        self.size = self.source.size()

    def read(self, first: int, size: int) -> bytes:
        """At most ``size`` bytes from ``first`` on; fewer at the end, none behind it."""
        there = min(size, max(0, self.size - first))
        return self.source.read_at(there, first) if there > 0 else b""

    def close(self) -> None:
        self.source.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_range(path: str, first: int, size: int) -> bytes:
    with Ranges(path) as source:
        return source.read(first, size)


def write_files(rows: DataFrame) -> int:
    """Write every (path, content) row as one file; returns the number of bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [replace_file(p, iter([bytes(c)])) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"n": sizes})

    named = rows.select("path", F.col("content").cast("binary").alias("content"))
    return named.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
