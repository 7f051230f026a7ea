"""Entries of large JSON files, one by one: a file is never in memory as a whole.

Spark reads a JSON file with one object or list as a single row. Here a task reads the
file in pieces, inflates it where it is packed, and hands on one row per entry of the
outermost object or list, with the entry's own text; Spark's JSON functions take it from
there.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import dropwhile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tonewell.sources.files import Ranges, file_path

#: Bytes read at a time; characters and entries that are handed on together.
PIECE, HELD_CHARS, HELD_ROWS = 1 << 20, 4 << 20, 5_000
ENTRY = "path string, pos bigint, key string, value string, error string"

STRING = r'"(?:[^"\\]|\\.)*+"'
#: Inside a value only strings and brackets matter; a quote alone opens a string that goes on.
NESTED = re.compile(rf"{STRING}|[{{}}\[\]\"]", re.S)
TOKEN = re.compile(rf"{STRING}|[{{}}\[\],:]|[^\s{{}}\[\],:\"]+", re.S)
SPACE = re.compile(r"\s*")
SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


class Reader:
    """Text that arrives in pieces, with a place in it; what lies behind the place is let go."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.text, self.at, self.ended = iter(pieces), "", 0, False

    def more(self) -> bool:
        """Add the next piece; false at the end."""
        for piece in self.pieces:
            if piece:
                self.text, self.at = self.text[self.at :] + piece, 0
                return True
        self.ended = True
        return False

    def peek(self) -> str:
        """The next character that is no white space, or nothing at the end."""
        while True:
            self.at = SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def token(self) -> str:
        """A string or scalar as it is written."""
        self.peek()
        while True:
            found = TOKEN.match(self.text, self.at)
            # a token that ends with the text may go on in the next piece
            if found and (found.end() < len(self.text) or self.ended):
                self.at = found.end()
                return found.group()
            if not self.more():
                if found:
                    continue
                raise ValueError("JSON text cut off")

    def value(self) -> str:
        """The next value as it is written, whatever is in it."""
        if self.peek() not in "{[":
            raw = self.token()
            if raw[0] != '"' and not SCALAR.fullmatch(raw):
                raise ValueError(f"not a JSON value: {raw[:20]}")
            return raw
        depth, seen = 0, 0  # how far the value was looked through, counted from its start
        while True:
            for found in NESTED.finditer(self.text, self.at + seen):
                mark = found.group()
                if mark == '"':
                    seen = found.start() - self.at
                    break
                depth += (mark in "{[") - (mark in "}]") if len(mark) == 1 else 0
                seen = found.end() - self.at
                if depth == 0:
                    raw = self.text[self.at : found.end()]
                    self.at = found.end()
                    return raw
            else:
                seen = len(self.text) - self.at
            if not self.more():
                raise ValueError("JSON text cut off")


def entries(pieces: Iterable[str]) -> Iterator[tuple[str | None, str]]:
    """``(key, value)`` texts of the outermost object, ``(None, value)`` of the outermost list."""
    reader = Reader(pieces)
    kind = reader.peek().removeprefix("\ufeff")
    if not kind and reader.text[reader.at :]:
        reader.at += 1
        kind = reader.peek()
    if kind not in ("{", "["):
        raise ValueError("neither an object nor a list" if kind else "empty JSON text")
    reader.at += 1
    closing = "}" if kind == "{" else "]"
    if reader.peek() != closing:
        while True:
            key = None
            if kind == "{":
                if reader.peek() != '"':
                    raise ValueError("a key was expected")
                key = json.loads(reader.token(), strict=False)
                if reader.peek() != ":":
                    raise ValueError("no colon behind a key")
                reader.at += 1
            if not reader.peek() or reader.peek() in ",:}]":
                raise ValueError("a value was expected")
            yield key, reader.value()
            mark = reader.peek()
            if mark == closing:
                break
            if mark != ",":
                raise ValueError("entries without a comma" if mark else "JSON text cut off")
            reader.at += 1
    reader.at += 1
    if reader.peek():
        raise ValueError("text behind the end")


def leaves(text: str) -> dict[str, str]:
    """Dotted name to the text of each scalar or list of nested objects, however deep; the last of equal names counts."""
    out: dict[str, str] = {}
    names: list[str] = []
    reader = Reader([text])
    if reader.peek() != "{":
        raise ValueError("not an object")
    reader.at += 1
    first = True  # right behind an opening brace
    while True:
        mark = reader.peek()
        if mark == "}":
            reader.at += 1
            if not names:
                break
            names.pop()
            first = False
            continue
        if not first:
            if mark != ",":
                raise ValueError("entries without a comma" if mark else "JSON text cut off")
            reader.at += 1
        if reader.peek() != '"':
            raise ValueError("a key was expected")
        key = json.loads(reader.token(), strict=False)
        if reader.peek() != ":":
            raise ValueError("no colon behind a key")
        reader.at += 1
        mark = reader.peek()
        if not mark or mark in ",:}]":
            raise ValueError("a value was expected")
        if mark == "{":
            reader.at += 1
            names.append(key)
            first = True
            continue
        raw = reader.value()
        if raw[0] in '["':
            json.loads(raw, strict=False)
        # empty keys at the front leave no dot
        out[".".join([*dropwhile(lambda x: not x, names), key])] = raw
        first = False
    if reader.peek():
        raise ValueError("text behind the end")
    return out


def text_pieces(source, packed: bool) -> Iterator[str]:
    """The text of a file in pieces, inflated where ``packed``."""
    decode = codecs.getincrementaldecoder("utf-8")().decode
    inflate = zlib.decompressobj(47) if packed else None
    for at in range(0, source.size, PIECE):
        raw = source.read(at, PIECE)
        if inflate is None:
            yield decode(raw)
            continue
        while raw:
            if inflate.eof:  # the next member of the same file
                inflate = zlib.decompressobj(47)
            yield decode(inflate.decompress(raw, PIECE))
            while inflate.unconsumed_tail:
                yield decode(inflate.decompress(inflate.unconsumed_tail, PIECE))
            raw = inflate.unused_data
    if inflate is not None and not inflate.eof:
        raise ValueError("gzip file cut off")
    yield decode(b"", True)


def json_entries(spark: SparkSession, root: str, pattern: str = "*.json*") -> DataFrame:
    """``(path, pos, key, value, error)``: the entries of each matching file, plain or gzip, found recursively.

    ``value`` is JSON text, ``key`` null in a list, ``pos`` counts from 0. A file that breaks
    off or is no JSON gives the entries before the fault and a row with ``error``. Memory
    is bounded by the longest single entry. Empty files give no row.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(file_path().alias("path"))
    )
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def scan(path: str) -> Iterator[tuple]:
        pos = 0
        try:
            with Ranges(path) as source:
                for key, value in entries(text_pieces(source, source.read(0, 2) == b"\x1f\x8b")):
                    yield path, pos, key, value, None
                    pos += 1
        except Exception as exc:
            yield path, pos, None, None, str(exc)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                for row in scan(path):
                    rows.append(row)
                    held += len(row[3] or "")
                    if len(rows) >= HELD_ROWS or held >= HELD_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(read, ENTRY)
