"""Removal of byte strings that a smaller document holds too: suffix arrays over shards.

Two documents that share a string of ``LENGTH`` bytes share the gram of ``GRAM`` bytes with
the smallest hash in it, its anchor. Anchors say which stretches can repeat at all;
the stretches around shared anchors are dealt by anchor, so that equal strings meet in
one shard, and the shard's suffix array tells exactly which strings are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import long_ids, written
from tonewell.llm.fertility import mixed

LENGTH, GRAM = 50, 20
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
SHARD = "shard long, doc_ids binary, named binary, ends binary, size long, text binary, others binary"
FRAGMENT = (
    "part long, shard long, numbers binary, starts binary, docs binary, contexts binary, sizes binary, lefts binary"
)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(array: np.ndarray, level: int = 9) -> bytes:
    import pyarrow as pa

    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), kind)


def place_of(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of the hash range of each hash, and 32 bits of its place in the part.

    A part holds some hundred thousand anchors, so about one in ten thousand agrees with
    another by chance, which costs a needless comparison of contexts.
    """
    part = hashes % np.uint64(parts)
    return part.astype(np.int64), (hashes // np.uint64(parts)).astype(np.uint32)


def shards(docs: DataFrame, shard_bytes: int = 1 << 21, others: bool = False) -> DataFrame:
    """Texts of a task's rows, joined and compressed in shards of about ``shard_bytes``.

    With ``others`` a shard also holds all columns but the text of its rows, so that the
    rows can be given back whole without a join.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        part, seq, held, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            text = np.frombuffer(b"".join(texts), np.uint8)
            sink = pa.BufferOutputStream()
            if others:
                table = pa.Table.from_batches(held).drop_columns(["__id", "__text"])
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
            columns = {
                "shard": pa.array([(part << 32) + seq], pa.int64()),
                "doc_ids": pa.array([pack(np.array([0 if x is None else x for x in ids], np.int64))], pa.binary()),
                "named": pa.array([pack(np.array([x is not None for x in ids]))], pa.binary()),
                "ends": pa.array([pack(np.cumsum([len(t) for t in texts]).astype(np.int64))], pa.binary()),
                "size": pa.array([len(text)], pa.int64()),
                "text": pa.array([pack(text)], pa.binary()),
                "others": pa.array([pack(np.frombuffer(sink.getvalue(), np.uint8))], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            values = pc.cast(batch.column("__text"), pa.binary()).to_pylist()
            from_ = 0
            for i, (doc_id, text) in enumerate(zip(batch.column("__id").to_pylist(), values, strict=True)):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= shard_bytes or len(ids) >= 20000:
                    held.append(batch.slice(from_, i + 1 - from_))
                    yield row()
                    from_ = i + 1
                    seq, held, ids, texts, size = seq + 1, [], [], [], 0
            if from_ < batch.num_rows:
                held.append(batch.slice(from_))
        if ids:
            yield row()

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"] if others else []
    rows = docs.select(*kept, F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    return rows.mapInArrow(cut, SHARD)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(
    text: np.ndarray, ends: np.ndarray, named: np.ndarray, slice_bytes: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some string of ``LENGTH`` bytes of one document.

    Documents go through in slices, so that only the places of a whole shard are held.
    """
    cuts = np.unique(np.searchsorted(ends, np.arange(slice_bytes, len(text) + slice_bytes, slice_bytes), "right"))
    places, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    for end in [*cuts[(cuts > 0) & (cuts < len(ends))].tolist(), len(ends)]:
        first, last = (int(ends[at - 1]) if at else 0), int(ends[end - 1])
        place, value = _anchors(text[first:last], ends[at:end] - first, named[at:end])
        places.append(place + first)
        hashes.append(value)
        at = end
    return np.concatenate(places), np.concatenate(hashes)


def _anchors(text: np.ndarray, ends: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(text) - GRAM + 1
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view(np.uint64).ravel()
    hashes = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= (word[8 : 8 + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes += word[12 : 12 + n] * np.uint64(0x165667B19E3779F9)
    hashes = np.minimum(mixed(hashes), TOP - np.uint64(1))
    del word
    low = sliding(hashes, LEFT + 1, np.minimum)  # of the string that starts here
    bad = np.zeros(len(low) + 1, np.int32)
    starts = np.r_[0, ends[:-1]]
    last = np.maximum(ends - LENGTH + 1, starts)  # first place where no string fits
    last = np.where(named, last, starts)
    np.add.at(bad, np.minimum(last, len(low)), 1)
    np.add.at(bad, np.minimum(ends, len(low)), -1)
    low[np.cumsum(bad[:-1]) > 0] = 0
    edge = np.zeros(LEFT, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), LEFT + 1, np.maximum)
    place = np.flatnonzero(high == hashes)
    return place, hashes[place]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (0 to 256).

    Larsson-Sadakane: suffixes start sorted by seven symbols; then groups that are still
    equal are sorted by the group numbers of the suffixes behind them, which doubles the
    sorted depth, and suffixes alone in their group are never looked at again.
    """
    n, known = len(symbols), 7
    tail = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(known, np.int64)])  # the end sorts first
    key = np.zeros(n, np.int64)
    for j in range(known):
        key = (key << 9) | tail[j : j + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    del key, tail
    # the number of a group is its first place
    number = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[order] = number + 1
    unsorted = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(unsorted):
        members = order[unsorted]
        group = rank[members]
        behind = rank[np.minimum(members.astype(np.int64) + known, n)]
        key = (group.astype(np.int64) << 32) | behind
        turn = np.argsort(key)
        key, members = key[turn], members[turn]
        order[unsorted] = members
        head = np.r_[True, key[1:] != key[:-1]]
        number = np.maximum.accumulate(np.where(head, unsorted, 0))
        rank[members] = number + 1
        unsorted = unsorted[~(head & np.r_[head[1:], True])]
        known *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, begin: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes with the preceding suffix, at ``counts`` places from each of ``begin``.

    Every stretch of places is one lane: a lane's prefix is at most one shorter than the
    one before it, and all lanes move on together. Prefixes are cut at ``most``.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    tail = np.concatenate([symbols, np.zeros(most + 1, symbols.dtype)])
    out = np.zeros(n, np.int16)
    prefix = np.zeros(len(begin), np.int16)
    for step in range(int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > step)
        here = begin[lanes] + step
        there = before[here]
        size = np.where(there >= 0, np.maximum(prefix[lanes] - 1, 0), 0).astype(np.int16)
        live = np.flatnonzero(there >= 0)
        while len(live):
            same = tail[here[live] + size[live]] == tail[there[live] + size[live]]
            live = live[same]
            size[live] += 1
            live = live[size[live] < most]
        prefix[lanes] = size
        out[here] = size
    return out


def smallest_holders(contexts: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every string of ``LENGTH`` bytes inside each context, the smallest ``doc`` of a context that holds it."""
    n = len(contexts)
    symbols = np.zeros((n, WIDTH + 1), np.uint16)
    symbols[:, :WIDTH] = contexts.astype(np.uint16) + 1
    symbols[np.arange(WIDTH + 1)[None, :] >= sizes[:, None]] = 0  # also the border to the next context
    symbols = symbols.ravel()
    order = suffix_array(symbols)
    begin = np.arange(n, dtype=np.int64) * (WIDTH + 1)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    prefix = common_prefixes(symbols, order, begin, counts, LENGTH)
    first = np.flatnonzero(prefix[order] < LENGTH)
    least = np.minimum.reduceat(doc[order // (WIDTH + 1)], first)
    holder = np.empty(len(symbols), np.int64)
    holder[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    return holder.reshape(n, WIDTH + 1)[:, : LEFT + 1]


def _shard(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row.doc_ids, np.int64), unpack(row.named, bool), unpack(row.ends, np.int64), unpack(row.text, np.uint8)


def shared_anchors(table: DataFrame, parts: int, hot: int) -> DataFrame:
    """``part, shard, places, hot``: the anchors of each shard that another shard holds as well, sorted.

    A shard sends each of its anchors once, in one packed list for every part of the hash
    range; the lists of a part are merged, and what two shards hold goes back to them.
    ``hot`` marks anchors that more than ``hot`` shards hold.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                _, named, ends, text = _shard(row)
                part, place = place_of(anchors(text, ends, named)[1], parts)
                order = np.lexsort((place, part))
                part, place = part[order], place[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    own = np.unique(place[cuts[p] : cuts[p + 1]])
                    rows.append((int(p), row.shard, own.tobytes()))
            yield pd.DataFrame(rows, columns=["part", "shard", "places"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint32) for x in group["places"]]
        every, counts = np.unique(np.concatenate(lists), return_counts=True)
        several, often = every[counts > 1], counts[counts > 1] > hot
        rows = []
        for part, shard, own in zip(group["part"], group["shard"], lists, strict=True):
            at = np.minimum(np.searchsorted(several, own), max(0, len(several) - 1))  # binary search in the merged list
            hit = several[at] == own if len(several) else np.zeros(len(own), bool)
            if hit.any():
                rows.append((part, shard, own[hit].tobytes(), often[at[hit]].tobytes()))
        return pd.DataFrame(rows, columns=["part", "shard", "places", "hot"])

    sent = table.select("shard", "doc_ids", "named", "ends", "text").mapInPandas(send, "part long, shard long, places binary")
    return sent.groupBy("part").applyInPandas(merge, "part long, shard long, places binary, hot binary")


def contexts_of(text, starts, ends, place, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each place, inside its document: the bytes, how many, and how many of them lie before it."""
    left = np.minimum(place - starts[doc], LEFT)
    size = left + np.minimum(ends[doc] - place, LENGTH)
    padded = np.concatenate([text, np.zeros(WIDTH, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place - left]
    out[np.arange(WIDTH)[None, :] >= size[:, None]] = 0
    return out, size, left


def row_hash(contexts: np.ndarray, size: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(contexts).view(np.uint64)
    out = mixed(size.astype(np.uint64))
    for j in range(words.shape[1]):
        out = mixed(out ^ words[:, j])
    return out


def repeats(docs: DataFrame, shard_bytes: int = 1 << 21, part_bytes: int = 1 << 23, hot: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a
    smaller doc_id; strings are those of the whole input texts. Null text is empty. Rows
    that share a doc_id don't count against each other. A row with a null doc_id takes
    no part: nothing is removed from it, and it removes nothing. An empty table gives no
    row; other columns are ignored.

    A shard sends an anchor once and a context once, however many of its documents hold
    them. The contexts of a ``hot`` anchor, one that many shards hold, are dealt by the
    strings in them rather than by the anchor.
    """
    return _run(docs, shard_bytes, part_bytes, hot, texts=False)


def without_repeats(docs: DataFrame, shard_bytes: int = 1 << 21, part_bytes: int = 1 << 23, hot: int = 4096) -> DataFrame:
    """``docs`` with what ``repeats`` counts taken out of ``text``; all other columns stay.

    What is left of a character that was cut apart goes as well. Null text stays null.
    """
    out = _run(docs, shard_bytes, part_bytes, hot, texts=True)
    return out.withColumn("text", F.when(F.col("__null"), F.lit(None)).otherwise(F.col("text"))).drop("__null")


def _run(docs: DataFrame, shard_bytes: int, part_bytes: int, hot: int, texts: bool) -> DataFrame:
    given = docs.withColumn("__null", F.col("text").isNull()) if texts else docs
    table = written(shards(given, shard_bytes, others=texts), "shards")
    total = table.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    shared = shared_anchors(table, parts, hot)

    def send(key, rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            out += _fragments(row, lists, parts)
        return pd.DataFrame(out, columns=[c.split()[0] for c in FRAGMENT.split(", ")])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_ranges(group), columns=["shard", "begin", "finish"])

    plain = table.select("shard", "doc_ids", "named", "ends", "text")
    sent = plain.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(send, FRAGMENT)
    found = sent.groupBy("part").applyInPandas(compare, "shard long, begin binary, finish binary")
    found = written(found, "ranges")
    both = table.groupBy("shard").cogroup(found.groupBy("shard"))
    if not texts:
        return both.applyInPandas(lambda key, rows, lists: _counted(rows, lists), RESULT)
    columns = given.columns

    def whole(rows, lists):
        import pyarrow as pa

        out = []
        held = lists.to_pandas()
        for row in rows.to_pandas().itertuples():
            _, _, ends, text = _shard(row)
            covered = _covered(held, len(text))
            left = [text[a:b][~covered[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            table = pa.ipc.open_stream(unpack(row.others, np.uint8).tobytes()).read_all()
            table = table.append_column("text", pa.array(left, pa.string()))
            out.append(table.select(columns))
        return pa.concat_tables(out) if out else pa.table({c: [] for c in columns})

    return both.applyInArrow(whole, given.schema)


def _fragments(row, lists: pd.DataFrame, parts: int) -> list[tuple]:
    """Contexts of a shard's shared anchors with their occurrences, a row for every part of the hash range."""
    ids, named, ends, text = _shard(row)
    place, value = anchors(text, ends, named)
    part, spot = place_of(value, parts)
    key = (part.astype(np.uint64) << np.uint64(32)) | spot
    starts = np.r_[0, ends[:-1]]
    doc = np.searchsorted(ends, place, side="right")
    across, often = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for p, spots, hot in zip(lists["part"], lists["places"], lists["hot"], strict=True):
        across.append((np.uint64(p) << np.uint64(32)) | np.frombuffer(spots, np.uint32).astype(np.uint64))
        often.append(np.frombuffer(hot, bool))
    across, often = np.concatenate(across), np.concatenate(often)
    turn = np.argsort(across)
    across, often = across[turn], often[turn]
    # anchors that two documents of this shard hold
    by = np.lexsort((ids[doc], key))
    v, d = key[by], ids[doc][by]
    inside = np.unique(v[1:][(v[1:] == v[:-1]) & (d[1:] != d[:-1])])
    at = np.minimum(np.searchsorted(across, key), max(0, len(across) - 1))
    outside = across[at] == key if len(across) else np.zeros(len(key), bool)
    is_hot = outside & often[at] if len(across) else outside
    keep = outside | np.isin(key, inside)
    place, value, doc, is_hot = place[keep], value[keep], doc[keep], is_hot[keep]
    if not len(place):
        return []
    contexts, size, left = contexts_of(text, starts, ends, place, doc)
    start = place - left
    if is_hot.any():
        contexts, size, left, start, value, doc = _single(contexts, size, left, start, value, doc, is_hot)
    _, one, which = np.unique(row_hash(contexts, size) ^ mixed(value), return_index=True, return_inverse=True)
    part = place_of(value[one], parts)[0]
    turn = np.argsort(part, kind="stable")
    one, part = one[turn], part[turn]
    number = np.empty(len(turn), np.int64)
    number[turn] = np.arange(len(turn))
    which = number[which]
    order = np.argsort(which, kind="stable")
    which, start, doc = which[order], start[order], doc[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = int(cuts[p]), int(cuts[p + 1])
        x, y = np.searchsorted(which, [a, b])
        own = one[a:b]
        out.append(
            (
                int(p), row.shard, pack((which[x:y] - a).astype(np.int32)), pack(start[x:y].astype(np.uint32)),
                pack(ids[doc[x:y]]), pack(contexts[own]), pack(size[own].astype(np.int8)), pack(left[own].astype(np.int8)),
            )
        )
    return out


def _ranges(group: pd.DataFrame, slice_rows: int = 1 << 16) -> list[tuple]:
    """Byte ranges of each shard that a string of a smaller document covers, from one part's contexts."""
    lists = [unpack(x, np.uint8).reshape(-1, WIDTH) for x in group["contexts"]]
    first = np.cumsum([0, *map(len, lists)])
    contexts = np.concatenate(lists)
    size = np.concatenate([unpack(x, np.int8) for x in group["sizes"]]).astype(np.int64)
    left = np.concatenate([unpack(x, np.int8) for x in group["lefts"]]).astype(np.int64)
    numbers = [unpack(x, np.int32) for x in group["numbers"]]
    owner = np.repeat(np.arange(len(group)), [len(x) for x in numbers])
    context = np.concatenate(numbers).astype(np.int64) + first[owner]
    start = np.concatenate([unpack(x, np.uint32) for x in group["starts"]]).astype(np.int64)
    doc = np.concatenate([unpack(x, np.int64) for x in group["docs"]])

    _, one, which = np.unique(row_hash(contexts, size), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which[context], doc)
    contexts, size, left = contexts[one], size[one], left[one]
    # only where an anchor stands in different contexts can strings differ in what holds them
    _, anchor, spread = np.unique(_grams(contexts, left), return_inverse=True, return_counts=True)
    several = np.flatnonzero(spread[anchor] > 1)
    holder = smallest_holders(contexts[several], size[several], least[several]) if len(several) else None
    row_of = np.full(len(one), -1, np.int64)
    row_of[several] = np.arange(len(several))

    context = which[context]
    found = [np.empty((3, 0), np.int64)]
    for at in range(0, len(context), slice_rows):
        part = slice(at, at + slice_rows)
        c, d = context[part], doc[part]
        low = np.broadcast_to(least[c][:, None], (len(c), LEFT + 1))
        if holder is not None:
            low = np.where((row_of[c] >= 0)[:, None], holder[row_of[c]], low)
        hit = np.zeros((len(c), LEFT + 3), np.int8)  # with an empty column on both sides
        hit[:, 1:-1] = (np.arange(LEFT + 1)[None, :] < (size[c] - LENGTH + 1)[:, None]) & (low < d[:, None])
        edge = np.diff(hit, axis=1)
        r, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        s = start[part][r]
        found.append(np.stack([owner[part][r], s + begin, s + end - 1 + LENGTH]))
    owners, begin, end = np.concatenate(found, axis=1)
    order = np.argsort(owners, kind="stable")
    owners, begin, end = owners[order], begin[order], end[order]
    cuts = np.searchsorted(owners, np.arange(len(group) + 1))
    return [
        (shard, pack(begin[a:b]), pack(end[a:b]))
        for shard, a, b in zip(group["shard"], cuts, cuts[1:], strict=False)
        if b > a
    ]


def _counted(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """What goes from each document of a shard."""
    out, names = [], []
    for row in rows.itertuples():
        ids, named, ends, text = _shard(row)
        covered = _covered(lists, len(text))
        starts = np.r_[0, ends[:-1]]
        gone = np.r_[0, np.cumsum(covered)]
        first = covered.copy()
        if len(first):
            first[1:] &= ~covered[:-1]
            begins = starts[starts < len(first)]
            first[begins] = covered[begins]
        spans = np.r_[0, np.cumsum(first)]
        for i, there, a, b in zip(ids.tolist(), named.tolist(), starts.tolist(), ends.tolist(), strict=True):
            removed = int(gone[b] - gone[a])
            kept = text[a:b][~covered[a:b]] if removed else text[a:b]
            names.append(i if there else None)
            out.append((b - a, removed, int(spans[b] - spans[a]), sha256(kept.tobytes()).hexdigest()))
    made = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")[1:]])
    made.insert(0, "doc_id", long_ids(names))
    return made


def _grams(contexts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hash of the anchor in each context; a context that is one string counts as its own anchor."""
    grams = np.zeros((len(contexts), WIDTH), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(contexts, GRAM, axis=1)
    grams[:, :GRAM] = windows[np.arange(len(contexts)), np.maximum(left, 0)]
    return np.where(left >= 0, row_hash(grams, np.full(len(contexts), GRAM)), row_hash(contexts, left.astype(np.uint64)))


def _single(contexts, size, left, start, value, doc, is_hot):
    """Contexts of hot anchors as their single strings, each dealt by its own hash."""
    calm = ~is_hot
    r, o = np.nonzero((np.arange(LEFT + 1)[None, :] < (size - LENGTH + 1)[:, None]) & is_hot[:, None])
    strings = np.zeros((len(r), WIDTH), np.uint8)
    strings[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(contexts, LENGTH, axis=1)[r, o]
    length = np.full(len(r), LENGTH, size.dtype)
    return (
        np.concatenate([contexts[calm], strings]),
        np.concatenate([size[calm], length]),
        np.concatenate([left[calm], np.full(len(r), -1, left.dtype)]),
        np.concatenate([start[calm], start[r] + o]),
        np.concatenate([value[calm], row_hash(strings, length)]),
        np.concatenate([doc[calm], doc[r]]),
    )


def _covered(lists: pd.DataFrame, size: int) -> np.ndarray:
    """Bytes of a shard in some of its ranges."""
    edge = np.zeros(size + 1, np.int32)
    for begin, end in zip(lists["begin"], lists["finish"], strict=True):
        np.add.at(edge, unpack(begin, np.int64), 1)
        np.add.at(edge, unpack(end, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0
