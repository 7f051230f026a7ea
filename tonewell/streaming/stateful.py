"""Keyed state of streams: sliding windows over chunks, moving averages by event time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows of a clip that are looked at together before those out of turn go to the state.
ROWS = 1000


class ChunkWindows(StatefulProcessor):
    """Emit the full windows of a clip and carry its tail to the next chunk.

    State per clip: the samples behind the last emitted window start, the numbers of
    the next window and the next chunk, and the chunks that came before their turn.
    The last chunk, or ``timeout_ms`` without a new one, flushes the rest as one
    window completed by zeros.
    """

    def __init__(self, kernel: int, stride: int, timeout_ms: int | None = None):
        self.kernel, self.stride, self.timeout_ms = kernel, stride, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "tail array<double>, next bigint, chunk bigint, last bigint")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "samples array<double>")

    def _rows(self, clip, first: int, windows: list) -> Iterator[Row]:
        for frame, window in enumerate(windows, first):
            yield Row(clip_id=clip, frame=frame, values=window.tolist())

    def _flush(self, clip, tail: np.ndarray, following: int) -> Iterator[Row]:
        # What is left is a window of its own unless the last one covered it all.
        covered = self.kernel - self.stride if following else 0
        if len(tail) > covered:
            padded = np.zeros(self.kernel)
            padded[: len(tail)] = tail
            yield from self._rows(clip, following, [padded])

    def _next(self, fresh: dict, held: bool, chunk: int):
        """Samples of a chunk, which came just now or waited before; None if it has not come."""
        if chunk in fresh:
            if held:
                self.waiting.removeKey((chunk,))
            return fresh.pop(chunk)
        found = self.waiting.getValue((chunk,)) if held else None
        if found is None:
            return None
        self.waiting.removeKey((chunk,))
        return found[0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clip, kept = key[0], self.state.get()
        tail, following, chunk, last = kept or ([], 0, 0, -1)
        tail = np.asarray(tail, dtype=np.float64)
        # Every call of the state is a message to the JVM: chunks in their turn never enter it.
        held = self.waiting.exists()
        for some in batched(rows, ROWS):
            fresh = {}
            for row in some:
                last = row["chunk_idx"] if row["is_last"] else last
                if row["chunk_idx"] >= chunk:
                    fresh[row["chunk_idx"]] = row["samples"]
            # All chunks whose turn has come, one at a time.
            while (samples := self._next(fresh, held, chunk)) is not None:
                buffer = np.concatenate([tail, np.asarray(samples, dtype=np.float64)])
                chunk += 1
                count = max(0, (len(buffer) - self.kernel) // self.stride + 1)
                windows = [buffer[i * self.stride : i * self.stride + self.kernel] for i in range(count)]
                yield from self._rows(clip, following, windows)
                tail, following = buffer[count * self.stride :], following + count
            for index, samples in fresh.items():
                self.waiting.updateValue((index,), ([float(v) for v in samples],))
                held = True
        if 0 <= last < chunk:
            yield from self._flush(clip, tail, following)
            if kept:
                self.state.clear()
        else:
            self.state.update((tail.tolist(), following, chunk, last))
            if self.timeout_ms is not None:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            tail, following, *_ = self.state.get()
            yield from self._flush(key[0], np.asarray(tail, dtype=np.float64), int(following))
            self.state.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def chunk_windows(
    stream: DataFrame, kernel: int, stride: int, timeout_ms: int | None = None, clip_type: str = "bigint"
) -> DataFrame:
    """(clip_id, frame, values) of a stream of (clip_id, chunk_idx, samples, is_last).

    Chunks of a clip are numbered from 0 and may arrive in any order and batch.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    mode = "ProcessingTime" if timeout_ms is not None else "None"
    return stream.groupBy("clip_id").transformWithState(
        statefulProcessor=ChunkWindows(kernel, stride, timeout_ms),
        outputStructType=f"clip_id {clip_type}, frame bigint, values array<double>",
        outputMode="Append",
        timeMode=mode,
    )


PARTS = "n bigint, top double, mass double, first double"
#: Seconds added to the order of a row: a watermark begins at zero, and what is not beyond it is late.
SHIFT = 10**9


def faded_sums(times: np.ndarray, values: np.ndarray, decay: float) -> tuple[int, float, float, float]:
    """(n, top, mass, first) of rows in order of time, then value.

    With r the place of a row, top is the sum of decay^(n - 1 - r) * value and mass the
    same sum of ones.
    """
    values = values[np.lexsort((values, times))]
    weight = decay ** np.arange(len(values) - 1, -1, -1, dtype=np.float64)
    return len(values), float(weight @ values), float(weight.sum()), float(values[0])


class FadedBlocks(StatefulProcessor):
    """Sums of one block of event time of one metric, handed on when the watermark has passed it.

    State per block: its rows as they come, one list entry per micro-batch. Entries are
    only added; a timer at the end of the block sums them up and removes them.
    """

    def __init__(self, width: float, decay: float, name: str):
        self.width, self.decay, self.name = width, decay, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "times array<double>, samples array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.rows.appendList([(batch["time"].tolist(), batch["value"].tolist()) for batch in rows])
        self.handle.registerTimer(int(np.ceil(((key[1] + 1) * self.width + SHIFT) * 1000)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = [(np.asarray(t, np.float64), np.asarray(v, np.float64)) for t, v in self.rows.get()]
        self.rows.clear()
        if kept:
            sums = faded_sums(*(np.concatenate(side) for side in zip(*kept, strict=True)), self.decay)
            columns = [self.name, "block", "n", "top", "mass", "first"]
            yield pd.DataFrame([(key[0], key[1], *sums)], columns=columns)

    def close(self) -> None:
        pass


def faded_blocks(stream: DataFrame, name: str, order: str, value: str, decay: float, lateness: float, width: float) -> DataFrame:
    """(name, block, n, top, mass, first) of each block of ``width`` seconds of ``order`` that is over.

    A block is over when a row more than ``lateness`` seconds behind its end has come. The
    blocks of a metric are keys of their own, so a hot metric is not one task. ``order``
    counts from any date, with seconds above -10^9.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    kind = stream.schema[name].dataType.simpleString()
    time = F.col(order).cast("double")
    rows = stream.filter(F.col(value).isNotNull() & time.isNotNull()).select(
        name, time.alias("time"), F.col(value).cast("double").alias("value"), F.floor(time / F.lit(width)).alias("block"),
        F.timestamp_micros(((time + SHIFT) * 1_000_000).cast("bigint")).alias("at"),
    )
    return rows.withWatermark("at", f"{round(lateness * 1000)} milliseconds").groupBy(name, "block").transformWithStateInPandas(
        statefulProcessor=FadedBlocks(width, decay, name),
        outputStructType=f"{name} {kind}, block bigint, {PARTS}",
        outputMode="Append",
        timeMode="EventTime",
    )
