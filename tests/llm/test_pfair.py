import random
from collections import defaultdict
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest

from tests.llm import tables
from tonewell.llm import pfair


@pytest.mark.parametrize("shares", [[1], [5, 3], [1, 1, 1], [100, 60, 50, 40, 4, 2], [7, 7, 7, 7, 228]])
def test_deadlines_hold_and_no_source_is_a_block_off(shares):
    period = sum(shares)
    pattern = list(islice(pfair.earliest(shares, [0] * len(shares)), period))
    for s, n in enumerate(shares):
        slots = [t for t, x in enumerate(pattern) if x == s]
        assert len(slots) == n
        for i, t in enumerate(slots):
            assert i * period // n <= t < -(-(i + 1) * period // n)
        done = np.cumsum([x == s for x in pattern])
        lag = n * np.arange(1, period + 1) / period - done
        assert np.abs(lag).max() < 1


def test_mix(spark):
    docs = tables.docs(spark)
    out = pfair.mix(spark, docs, block_chars=50, bucket_rows=2).collect()
    assert len(out) == len(tables.rows())
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in tables.rows())
    sources = defaultdict(set)
    for r in out:
        sources[r["slot"]].add(r["source"])
    assert all(len(x) == 1 for x in sources.values())  # a slot is one block of one source
    order = defaultdict(list)
    for r in sorted(out, key=lambda r: r["slot"]):
        order[r["source"]].append(r["block"])
    assert all(x == sorted(x) for x in order.values())


def test_blocks_are_running_sizes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = pfair.mix(spark, docs, block_chars=2000, bucket_rows=4).select("source", "block", "slot", "n_chars").collect()
    total, last = defaultdict(int), defaultdict(int)
    for r in out:
        total[r["source"]] += r["n_chars"] + 1
        last[r["source"]] = max(last[r["source"]], r["block"])
    assert all(last[s] < -(-total[s] // 2000) for s in total)


def test_order_settings_and_empty(spark):
    docs = tables.docs(spark)
    mixed = pfair.in_mix_order(spark, docs, block_chars=50)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    only = pfair.mix(spark, docs, weights={"a": 3.0, None: 1.0}, block_chars=50)
    assert only.count() == len(tables.rows())
    assert pfair.mix(spark, tables.empty(spark)).collect() == []
    assert pfair.in_mix_order(spark, tables.empty(spark)).collect() == []


@pytest.mark.parametrize(
    "weights", [[0.6, 0.25, 0.1, 0.05], [0.9, 0.1], [1 / 3, 2 / 3], [0.001, 0.999], [0.5, *[0.01] * 50], [1e-9, 3.0, 0.7]]
)
def test_no_source_is_a_block_off_its_weight(weights):
    exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    whole = pfair.whole_weights(weights)
    assert [Fraction(w, sum(whole)) for w in whole] == exact
    for t, (_, done, _) in enumerate(islice(pfair.turns([10**9] * len(weights), whole), 20000)):
        assert all(abs(n - w * t) < 1 for n, w in zip(done, exact, strict=True))


def test_slots_from_any_state(spark):
    blocks, weights = {"a": 400, "b": 37, "c": 1, "d": 130, "e": 20}, {"a": 1.0, "b": 3.0, "c": 0.5, "d": 0.1, "e": 0.0}
    once = [tuple(r) for r in pfair.slots_of(spark, blocks, weights).orderBy("mix_slot").collect()]
    assert [tuple(r) for r in pfair.slots_of(spark, blocks, weights, 7).orderBy("mix_slot").collect()] == once
    assert [t for _, _, t in once] == list(range(sum(blocks.values())))
    assert all([i for n, i, _ in once if n == s] == list(range(blocks[s])) for s in blocks)
    assert {n for n, _, _ in once[-20:]} == {"e"}  # no weight: after all others
    with pytest.raises(ValueError):
        pfair.whole_weights([1.0, -1.0])


def test_mix_keeps_to_the_weights_beyond_a_period(spark):
    rng, weights = random.Random(3), {"a": 0.6, "b": 0.25, "c": 0.1, "d": 0.05}
    rows = [(i, "x" * 9, rng.choices(list(weights), weights.values())[0]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pfair.mix(spark, docs, weights=weights, block_chars=10).select("source", "slot").collect()
    order = [r["source"] for r in sorted(out, key=lambda r: r["slot"])]
    assert len(order) == 6000 and len({r["slot"] for r in out}) == 6000
    total, left = sum(map(Fraction, weights.values())), {s: order.count(s) for s in weights}
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - Fraction(w) / total * t) < 1 for x, w in weights.items())
        if done[s] == left[s]:  # from here on the others share its weight
            break
    assert t > 2000


def plain_slots(blocks, weights):
    """Slot of every block by a plain loop: among the released blocks the one with the earliest deadline."""
    done, out, t0 = {s: 0 for s in blocks}, {}, 0
    while active := [s for s in sorted(blocks) if done[s] < blocks[s]]:
        total, begun, t = sum(weights[s] for s in active), dict(done), 0
        while all(done[s] < blocks[s] for s in active):
            ready = []
            for k, s in enumerate(active):
                i, w = done[s] - begun[s], weights[s] / total
                if i / w // 1 <= t:
                    ready.append((-(-(i + 1) / w // 1), k, s))
            s = min(ready)[2]
            out[s, done[s]] = t0 + t
            done[s] += 1
            t += 1
        t0 += t
    return out


@pytest.mark.parametrize("every", [1, 7, 1 << 16])
def test_slots_against_a_plain_loop(spark, every):
    rng = random.Random(2)
    for _ in range(4):
        names = "abcde"[: rng.randint(1, 5)]
        blocks = {s: rng.randint(1, 60) for s in names}
        weights = {s: Fraction(rng.randint(1, 20), rng.randint(1, 20)) for s in names}
        got = pfair.slots_of(spark, blocks, {s: float(w) for s, w in weights.items()}, every).collect()
        want = plain_slots(blocks, {s: Fraction(float(w)) for s, w in weights.items()})
        assert {(r["mix_name"], r["mix_block"]): r["mix_slot"] for r in got} == want


def test_documents_of_the_slots(spark, data):
    """The whole mix against a plain pass over the documents of each source in their order."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = pfair.mix(spark, docs, block_chars=3000, bucket_rows=16).collect()
    order = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, coalesce(text, ''), 11) AS h").collect()}
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    block, size = {}, {}
    for s, part in sources.items():
        at, cuts = 0, -(-len(part) // 16)
        bucket = {i: int((order[i] % (1 << 64) >> 11) / (1 << 53) * cuts) for i in (r["doc_id"] for r in part)}
        for r in sorted(part, key=lambda r: (bucket[r["doc_id"]], order[r["doc_id"]])):  # noqa: B023
            block[r["doc_id"]] = at // 3000
            at += len(r["text"] or "") + 1
        size[s] = at
    assert {r["doc_id"]: r["block"] for r in rows} == block
    want = plain_slots({s: -(-n // 3000) for s, n in size.items()}, {s: Fraction(n**0.7) for s, n in size.items()})
    assert all(want[r["source"], r["block"]] == r["slot"] for r in rows)


def test_many_slots_make_larger_blocks(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    monkeypatch.setattr(pfair, "MOST_SLOTS", 20)
    assert max(r["slot"] for r in pfair.mix(spark, docs, block_chars=10).collect()) < 20 + 10


def test_rows_of_one_id_spread(spark):
    rows = [(None, f"text {i}", "a") for i in range(500)] + [(1, f"text {i}", "a") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pfair.mix(spark, docs, block_chars=100, bucket_rows=10).collect()
    assert len(out) == 1000 and len({r["block"] for r in out}) > 50
