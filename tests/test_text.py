import hashlib
import json
import re

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tonewell.functions import text as X
from tonewell.functions.hashing import md5_mod, sha256_mod, uniform
from tonewell.operators import captions, corpus


def one(spark, values, *columns, schema="c string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [tuple(r) for r in rows.select(*columns).collect()]


def test_hashes_equal_python(spark):
    words = ["a", "é", "some longer text", ""]
    got = one(spark, words, md5_mod(F.col("c"), 100), sha256_mod(F.col("c"), 12345), uniform(3, F.col("c")))
    for word, (m, s, u) in zip(words, got):
        assert m == int(hashlib.md5(word.encode()).hexdigest(), 16) % 100
        assert s == int(hashlib.sha256(word.encode()).hexdigest(), 16) % 12345
        assert u == int(hashlib.md5(f"3|{word}".encode()).hexdigest()[:13], 16) / 2**52


def test_keywords(spark):
    got = one(spark, [None, "", "None", " Rock ", " None ", "  ", "\xa0Jazz "], X.get_keyword(F.col("c")))
    assert [g[0] for g in got] == [None, None, None, "rock", "none", "", "jazz"]


def test_keyword_lists(spark):
    got = one(spark, ["a, b c", None, ", ,"], X.get_keyword_list(F.col("c")))
    assert got == [(["a", "b", "c"],), (None,), (None,)]
    arrays = one(spark, [["A", "None", ""], []], X.get_keyword_list(F.col("c"), "array"), schema="c array<string>")
    assert arrays == [(["a"],), (None,)]
    numbers = one(spark, [float("nan"), 2.0], X.get_keyword_list(F.col("c"), "number"), schema="c double")
    assert numbers == [(None,), (["2.0"],)]


def test_key_and_bpm(spark):
    assert one(spark, ["C, D", " C Minor"], X.get_musical_key(F.col("c"))) == [(None,), ("c minor",)]
    assert one(spark, ["120", " 98.5 ", "fast"], X.get_bpm(F.col("c"))) == [(120.0,), (98.5,), (None,)]
    odd = ["120f", "120d", "1_20", "1__20", "1e2", ".5", "5.", "-3", "", "0x10", "1 2", "Infinity", "+inf"]
    want = [None, None, 120.0, None, 100.0, 0.5, 5.0, -3.0, None, None, None, float("inf"), float("inf")]
    assert one(spark, odd, X.get_bpm(F.col("c"))) == [(x,) for x in want]


def test_slugify(spark):
    values = ["Héllo  Wörld!", "--a_b--", "ﬁne ½ ß", "Ünïcode\tTab"]
    import unicodedata

    def expected(v):
        v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode()
        return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", v.lower())).strip("-_")

    assert [g[0] for g in one(spark, values, X.slugify(F.col("c")))] == [expected(v) for v in values]


def test_fold_takes_a_batch_by_slices(spark, monkeypatch):
    values = ["É", None, "½", "plain", "ﬁ", "語"]
    monkeypatch.setattr(X, "FOLD_ROWS", 2)
    assert X._fold_batch.func(pa.array(values)).to_pylist() == ["E", None, "12", "plain", "fi", ""]
    assert X._fold_batch.func(pa.array([], pa.string())).to_pylist() == []
    # What is ASCII already is not sent to Python.
    assert "RLIKE" in str(X._ascii_fold(F.col("c"))).upper()
    assert [g[0] for g in one(spark, values, X.slugify(F.col("c")))] == ["e", None, "12", "plain", "fi", ""]


def test_sample_id_uses_python_json(spark):
    rows = spark.createDataFrame([(7, {"b": "é\"x", "a": "Some Text"})], "i int, m map<string,string>")
    got = rows.select(X.sample_id(F.col("i"), F.lit(b"\x01\x02"), F.col("m"))).first()[0]
    text = json.dumps({"b": "é\"x", "a": "Some Text"}, sort_keys=True)
    digest = hashlib.sha1(b"7" + b"\x01\x02" + text.encode()).hexdigest()
    assert got == digest + "_prompted_a=some-text-b=ex"


def test_random_ids_differ(spark):
    none = F.lit(None).cast("map<string,string>")
    got = spark.range(5).select(X.sample_id(F.col("id"), F.lit(None).cast("binary"), none)).collect()
    assert len({r[0] for r in got}) == 5 and all(r[0].startswith("noinput_") for r in got)


def test_signature_equals_python(spark):
    names = ["a", "b c"]
    got = one(spark, [names], X.set_signature(F.col("c")), schema="c array<string>")[0][0]
    assert got == hashlib.sha1(json.dumps(names).encode()).hexdigest()[:10]


def test_merge_description_edges(spark):
    def merged(text, p, **fields):
        rows = spark.createDataFrame([(text, 1)], "c string, k int")
        columns = {n: F.lit(v).cast("string") for n, v in fields.items()}
        return rows.select(X.merge_description(F.col("c"), columns, F.col("k"), p, 0.0, 1.0)).first()[0]

    assert merged("x.", 1.0) == "x."
    assert merged("x", 1.0) == "x."
    assert merged(None, 1.0) is None
    assert merged("x.", 1.0, key="c minor") == "x. key: c minor"
    assert merged(None, 1.0, key="c minor") == "key: c minor"
    assert merged("x", 0.0, key="c minor") == "x."


def payload(**changes):
    base = {name: "some words" for name in captions.REQUIRED}
    base["description"] = "one two three four five six seven eight"
    base["genre_tags"] = ["Jazz", "jazz", " ", "Rock"]
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "DROP"})


def test_payloads(spark):
    cases = {
        "tags": payload(),
        "none": payload(genre_tags=[]),
        "short": payload(description="one two three four five six seven"),
        "long": payload(description=" ".join(f"w{i}" for i in range(61))),
        "missing": payload(accompaniment="DROP"),
        "nolist": payload(genre_tags="Jazz"),
        "blank": payload(general_mood="  ", lead_instrument=None),
        "broken": "no json",
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, payload string")
    got = {r["name"]: r for r in captions.normalise_payload(rows, "payload").collect()}
    assert got["tags"]["genre_tags"] == ["Jazz", "Rock"] and got["tags"]["error"] is None
    assert got["none"]["genre_tags"] == ["Unknown"]
    assert got["short"]["error"].startswith("description too short") and got["short"]["description"] is None
    assert len(got["long"]["description"].split()) == 60
    assert got["missing"]["error"] == "missing key: accompaniment"
    assert got["nolist"]["error"] == "genre_tags must be a list"
    assert got["blank"]["general_mood"] == "Unknown" and got["blank"]["lead_instrument"] == "Unknown"
    assert got["broken"]["error"] == "not a JSON object"


def test_flatten_config(spark):
    deep = {"z": {"y": {"x": {"w": {"v": {"u": {"t": {"s": "{not}"}}}}}}}}
    config = {"a": {"b": {"c": 1, "d": [1, 2]}, "e": True}, "f": "x", "g": None, **deep}
    rows = spark.createDataFrame([(1, json.dumps(config))], "id int, config string")
    got = {r["name"]: r["value"] for r in captions.flatten_config(rows, "id", "config").collect()}
    assert got == {"a.b.c": "1", "a.b.d": "[1,2]", "a.e": "true", "f": "x", "g": None, "z.y.x.w.v.u.t.s": "{not}"}
    assert captions.flatten_config(rows.limit(0), "id", "config").collect() == []


def test_configs_of_any_depth_and_broken_ones(spark):
    """Two hundred levels in the same plan; what is no JSON object is a row that says so."""
    deep = '{"a": ' * 200 + '"x"' + "}" * 200
    broken = ['{"a": 1', "[1]", "text", "", '{"a": tru}', '{"a": [1, }', '{"a" 1}', '{"a": 1} x', '{"a": "\\q"}', "{'a': 1}"]
    rows = [(0, deep), (1, '{"a": 1, "b": {"a": [1, {"c": null}], "d": {}}, "a": 2, "": {"": {"e": 1.50}}, "n": null}'), (2, None), (3, "{}")]
    rows += [(10 + i, t) for i, t in enumerate(broken)]
    df = spark.createDataFrame(rows, "id int, config string")
    got = [tuple(r) for r in captions.flatten_config(df, "id", "config").collect()]
    assert [r for r in got if r[0] == 0] == [(0, ".".join("a" * 200), "x", None)]
    assert {r[1]: r[2] for r in got if r[0] == 1} == {"a": "2", "b.a": '[1,{"c":null}]', "e": "1.5", "n": None}
    assert not [r for r in got if r[0] in (2, 3)]
    errors = {r[0]: r for r in got if r[3] is not None}
    assert set(errors) == {10 + i for i in range(len(broken))} and all(r[1] is None and r[2] is None for r in errors.values())



def test_word_dropout_limits(spark):
    assert one(spark, ["a b  c"], X.word_dropout(F.col("c"), 0.0, 1), X.word_dropout(F.col("c"), 1.0, 1)) == [("a b  c", "")]


def test_zip_path_needs_one_colon(spark):
    with pytest.raises(Exception, match="not a zip path"):
        one(spark, ["a:b:c"], X.parse_zip_path(F.col("c")))


def test_required_fields(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": null}',), ("{}",)], "raw string")
    got = [r["error"] for r in corpus.require_fields(rows, "raw", ["a", "b", "c"], optional=["c"]).collect()]
    assert got == [None, "missing fields: a, b"]
    with pytest.raises(Exception, match="missing fields"):
        corpus.require_fields(rows, "raw", ["a"], strict=True).collect()


def test_paths(spark):
    rows = spark.createDataFrame([("/in/a/b.x.mp3",), ("/other/c.mp3",)], "path string")
    got = corpus.rewrite_path(rows, "path", "/in", "/out", ".wav").select("out_path", "error").collect()
    assert got[0][0] == "/out/a/b.x.wav" and got[0][1] is None
    assert got[1][0] is None and got[1][1]
    assert one(spark, ["/x/.hidden", "a/b.c.d", "/z:in.json"], X.file_stem(F.col("c")), X.absolute_path(F.col("c"), "/r")) == [
        (".hidden", "/x/.hidden"), ("b.c", "/r/a/b.c.d"), ("z:in", "/z:in.json")
    ]


def test_small_helpers(spark):
    from tonewell.operators import ratings
    from tonewell.session import spread

    rows = spark.createDataFrame([("a", None), (None, "d")], "name string, description string")
    assert rows.filter(corpus.has_music_meta()).count() == 1 and rows.filter(corpus.has_sound_meta()).count() == 1
    assert corpus.limit_rows(rows, 0, ["name"]).count() == 2
    assert corpus.limit_rows(rows, 1, ["name"]).first()["description"] == "d"
    assert corpus.sample_with_repeat(rows.limit(0), 5, 1, "name").count() == 0
    given = spark.createDataFrame([("u", 1), ("u", 2)], "user string, rating int")
    assert [r[0] for r in ratings.raters(given).collect()] == ["u"]
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert spread(many).rdd.getNumPartitions() == 64
