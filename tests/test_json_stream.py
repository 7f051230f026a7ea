"""Entries of JSON files in pieces, against the standard library."""

import gzip
import json
import random
import tracemalloc

import pytest
from pyspark.errors import PySparkException

from tonewell.sources import json_stream as js
from tonewell.sources import sidecars


def value(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.25:
        return {rng.choice(["a", "b", 'ü"x', "{", "}", "\\", ""]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and kind < 0.45:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([1, -2.5, 1e300, True, None, "x", '"q"', "[", "]}", "\\", "\n ,:", "é漢"])


def flat(config, prefix=""):
    out = {}
    for k, v in config.items():
        name = f"{prefix}.{k}" if prefix else k
        out.update(flat(v, name) if isinstance(v, dict) else {name: v})
    return out


def read(text, size):
    return [(k, json.loads(v)) for k, v in js.entries(text[i : i + size] for i in range(0, len(text), size))]


def test_any_text_in_any_pieces():
    rng = random.Random(1)
    for _ in range(1500):
        v = value(rng)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        if not isinstance(v, (dict, list)):
            with pytest.raises(ValueError):
                read(text, 3)
            continue
        assert read(text, rng.randint(1, 9)) == (list(v.items()) if isinstance(v, dict) else [(None, x) for x in v])
        if isinstance(v, dict):
            assert {k: json.loads(x) for k, x in js.leaves(text).items()} == flat(v)
        cut = text[: rng.randrange(len(text))]
        for fn in (lambda t: list(js.entries([t])), js.leaves):
            with pytest.raises(ValueError):
                fn(cut)


@pytest.mark.parametrize("text", ['{"a":1,}', '{"a":1 "b":2}', "{1:2}", '{"a"}', "[1 2]", "[,]", "[1]]", '{"a":1}{', "", " ", "x", "[tru]", "[01]", "[1", '["a'])
def test_broken_texts(text):
    with pytest.raises(ValueError):
        list(js.entries([text]))


def test_duplicate_and_empty_keys():
    assert list(js.entries(['{"a": 1, "a": 2, "": 3}'])) == [("a", "1"), ("a", "2"), ("", "3")]
    assert js.leaves('{"a": {"b": 1}, "a": {"b": 2}}') == {"a.b": "2"}


def test_depth_costs_no_stack():
    n = 20_000
    assert js.leaves('{"a":' * n + "1" + "}" * n) == {".".join("a" * n): "1"}


def test_memory_is_that_of_a_piece():
    """Ten megabytes of entries, a few of them held at a time."""
    line = '"key": ["some text", "more {text}"],\n' * 2_000
    pieces = 10_000_000 // len(line)
    tracemalloc.start()
    n = sum(1 for _ in js.entries(["{", *(line for _ in range(pieces)), '"z": 1}']))
    assert n == 2_000 * pieces + 1 and tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_files(spark, tmp_path):
    """Plain and packed files of several pieces, several packed parts in one file, broken files."""
    rows = {f"k{i}": [f"text {i} é", "x" * (i % 50)] for i in range(40_000)}
    text = json.dumps(rows, ensure_ascii=False)
    (tmp_path / "plain.json").write_text(text, encoding="utf-8")
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(text.encode()[:700_001]) + gzip.compress(text.encode()[700_001:]))
    (tmp_path / "list.json").write_bytes(b"\xef\xbb\xbf[1, {\"a\": [2]}, null]")
    (tmp_path / "bad.json").write_text('{"a": 1, "b": }')
    (tmp_path / "cut.json.gz").write_bytes(gzip.compress(b"[1]" + b" " * 1000)[:20])
    (tmp_path / "bytes.json").write_bytes(b'["\xff"]')
    found = js.json_entries(spark, str(tmp_path)).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    for name in ("plain.json", "packed.json.gz"):
        got = by_file[name]
        assert [r["pos"] for r in got] == list(range(40_000)) and {r["key"]: json.loads(r["value"]) for r in got} == rows
    assert [(r["key"], r["value"]) for r in by_file["list.json"]] == [(None, "1"), (None, '{"a": [2]}'), (None, "null")]
    assert [(r["pos"], r["value"]) for r in by_file["bad.json"]] == [(0, "1"), (1, None)]
    for name in ("bad.json", "cut.json.gz", "bytes.json"):
        assert by_file[name][-1]["error"]


def test_readers_stop_at_broken_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"x": ["1", "2"], "y": []')
    with pytest.raises(PySparkException, match="bad JSON file"):
        sidecars.read_paraphrases(spark, str(tmp_path / "p")).collect()
    with pytest.raises(PySparkException, match="bad JSON file"):
        sidecars.read_paraphrases(spark, str(tmp_path / "p")).count()
