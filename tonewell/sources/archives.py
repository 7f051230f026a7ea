"""Members of ZIP archives, named ``archive.zip:inner/path``.

A task reads an archive's central directory in slices and hands on a row per member;
from then on every member is read on its own, at its place, without the directory:
stored ones by byte ranges, packed ones as a stream that is inflated no further than
asked for. ZIP64 sizes and places are understood.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tonewell.sources.files import Ranges, list_files, name_matches

# Fixed values of the format: signatures, lengths and layouts of its records.
END, END_SIZE = b"PK\x05\x06", 22
END64_PLACE, END64_PLACE_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_LAYOUT = b"PK\x01\x02", "<4s6H3L5H2L"
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
STORED, DEFLATED, BZIPPED = 0, 8, 12
ENCRYPTED, UTF8_NAME = 1, 0x800
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

#: Bytes of a directory or of a packed member that are held at a time, and members handed on together.
SLICE, MEMBERS = 1 << 20, 10_000
MEMBER = "struct<archive: string, place: bigint, packed: bigint, size: bigint, method: int, crc: bigint>"


def directory_place(source: Ranges) -> tuple[int, int, int]:
    """(first byte, bytes) of the central directory, and the bytes that stand before the archive proper."""
    tail_size = min(source.size, END_SIZE + FULL16)
    tail = source.read(source.size - tail_size, tail_size)
    at = tail.rfind(END)
    # the signature may also stand in the comment: a true end record's comment fills the file
    while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive")
    size, first = struct.unpack_from("<LL", tail, at + 12)
    end = source.size - tail_size + at
    record = source.read(end - END64_PLACE_SIZE, END64_PLACE_SIZE) if end >= END64_PLACE_SIZE else b""
    if record[:4] == END64_PLACE:
        # right before its locator, or where that says if it has fields of its own
        for place in (end - END64_PLACE_SIZE - END64_SIZE, struct.unpack_from("<Q", record, 8)[0]):
            wide = source.read(max(0, place), END64_SIZE)
            if wide[:4] == END64:
                break
        else:
            raise ValueError("ZIP64 end record not found")
        size, first = struct.unpack_from("<QQ", wide, 40)
        end = place
    if first + size > end:
        raise ValueError("ZIP directory outside the file")
    return end - size, size, end - size - first


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """64-bit values of the extra field in place of the full 32-bit ones, in their order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide, place, out = extra[at + 4 : at + 4 + size], 0, []
            for value in values:
                if value == FULL32:
                    value = struct.unpack_from("<Q", wide, place)[0]
                    place += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def members(source: Ranges) -> Iterator[tuple[str, int, int, int, int, int, str | None]]:
    """``(name, place, packed, size, method, crc, error)`` of the files of an archive, in its order."""
    first, size, shift = directory_place(source)
    head, held, at, read = struct.calcsize(ENTRY_LAYOUT), b"", 0, 0
    while True:
        if len(held) - at < head + 3 * FULL16 and read < size:
            more = source.read(first + read, min(max(SLICE, 4 * FULL16), size - read))
            if not more:
                raise ValueError("ZIP directory cut off")
            held, at, read = held[at:] + more, 0, read + len(more)
            continue
        if len(held) - at < head:
            return
        part = struct.unpack_from(ENTRY_LAYOUT, held, at)
        if part[0] != ENTRY:
            raise ValueError("bad entry in the ZIP directory")
        flags, method, crc = part[3], part[4], part[7]
        n_name, n_extra, n_comment = part[10:13]
        name = held[at + head : at + head + n_name]
        extra = held[at + head + n_name : at + head + n_name + n_extra]
        full, packed, place = _wide(extra, [part[9], part[8], part[16]])
        at += head + n_name + n_extra + n_comment
        text = name.decode("utf-8" if flags & UTF8_NAME else "cp437", "replace")
        if text.endswith("/"):
            continue
        error = None
        if flags & ENCRYPTED:
            error = "encrypted member"
        elif method not in (STORED, DEFLATED, BZIPPED):
            error = f"unsupported ZIP method {method}"
        yield text, place + shift, packed, full, method, crc, error


class Member:
    """The bytes of one member, read by ranges like a file.

    A stored member is a window on the archive. A packed one is inflated from its start
    in slices; a range before the last one starts anew, ranges in order cost one pass.
    The checksum is compared when a packed member has been read to its end.
    """

    def __init__(self, archive: str, place: int, packed: int, size: int, method: int, crc: int):
        self.archive, self.size, self.method, self.crc = Ranges(archive), size, method, crc
        local = self.archive.read(place, LOCAL_SIZE)
        if local[:4] != LOCAL:
            raise ValueError("no ZIP member at this place")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        self.first, self.packed = place + LOCAL_SIZE + n_name + n_extra, packed
        self._restart()

    def _restart(self) -> None:
        self.stream = zlib.decompressobj(-15) if self.method == DEFLATED else bz2.BZ2Decompressor()
        self.taken, self.at, self.sum, self.rest = 0, 0, 0, b""

    def _inflate(self, limit: int) -> bytes:
        """The next bytes, at most ``limit``; none at the end of the packed data."""
        while True:
            if not self.rest and self.taken < self.packed and getattr(self.stream, "needs_input", True):
                self.rest = self.archive.read(self.first + self.taken, min(SLICE, self.packed - self.taken))
                self.taken += len(self.rest)
            if self.method == DEFLATED:
                out = self.stream.decompress(self.rest, limit)
                self.rest = self.stream.unconsumed_tail
            else:
                out = b"" if self.stream.eof else self.stream.decompress(self.rest, limit)
                self.rest = b""
            if out or self.stream.eof or (not self.rest and self.taken >= self.packed):
                break
        self.at += len(out)
        self.sum = zlib.crc32(out, self.sum)
        if self.at == self.size and out and self.sum != self.crc:
            raise ValueError("bad checksum of a ZIP member")
        return out

    def read(self, first: int, size: int) -> bytes:
        size = min(size, max(0, self.size - first))
        if size <= 0:
            return b""
        if self.method == STORED:
            return self.archive.read(self.first + first, size)
        if first < self.at:
            self._restart()
        while self.at < first:
            if not self._inflate(min(SLICE, first - self.at)):
                raise ValueError("ZIP member cut off")
        parts = []
        while size > 0:
            parts.append(self._inflate(min(SLICE, size)))
            if not parts[-1]:
                raise ValueError("ZIP member cut off")
            size -= len(parts[-1])
        return b"".join(parts)

    def close(self) -> None:
        self.archive.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_source(path: str, member=None):
    """The file at ``path``, or the member of an archive that ``member`` (a row of ``MEMBER``) describes."""
    if member is None:
        return Ranges(path)
    return Member(*(member[c] if c == "archive" else int(member[c]) for c in ("archive", "place", "packed", "size", "method", "crc")))


def list_members(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] | None = None,
    pattern: str = "*.zip",
    listed: DataFrame | None = None,
) -> DataFrame:
    """``(path, length, member, error)`` of the files inside all archives below ``root``.

    ``path`` is ``archive:inner``; ``member`` is what ``open_source`` takes. Suffixes are
    compared in lower case. An archive that cannot be listed is one row with its own
    path and ``error``, as is a member that is encrypted or packed in another way.
    ``listed``: the files below ``root`` where they have been listed before.
    """
    files = list_files(spark, root) if listed is None else listed
    named = files.filter(name_matches(spark, pattern)).select("path")
    wanted = tuple(suffixes) if suffixes is not None else ("",)
    names = ["path", "length", "member", "error"]

    def entries(archive: str) -> Iterator[tuple]:
        try:
            with Ranges(archive) as source:
                for name, place, packed, size, method, crc, error in members(source):
                    if name.lower().endswith(wanted):
                        member = {"archive": archive, "place": place, "packed": packed, "size": size, "method": method, "crc": crc}
                        yield f"{archive}:{name}", size, member, error
        except Exception as exc:
            yield archive, None, None, str(exc)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive in batch["path"]:
                for row in entries(archive):
                    rows.append(row)
                    if len(rows) >= MEMBERS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return named.mapInPandas(read, f"path string, length bigint, member {MEMBER}, error string")


def read_members(found: DataFrame) -> DataFrame:
    """``(path, value, error)``: the whole text of each listed member, for small files such as sidecars.

    The members of an archive are dealt over the tasks, however many there are.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, member, error in zip(batch["path"], batch["member"], batch["error"], strict=True):
                value = None
                if error is None:
                    try:
                        with open_source(path, member) as source:
                            value = source.read(0, source.size).decode("utf-8")
                    except Exception as exc:
                        error = str(exc)
                rows.append((path, value, error))
            yield pd.DataFrame(rows, columns=["path", "value", "error"])

    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("path", "member", "error").repartition(partitions, "path")
    return dealt.mapInPandas(read, "path string, value string, error string")
