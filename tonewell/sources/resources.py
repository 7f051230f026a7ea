"""User functions over a costly resource: opened once per Python worker, used in batches.

A model, an index or a connection is opened by the first task of a worker process and
kept for all later ones. A batch that fails is tried again row by row, so that one bad
key is one row with an error and its neighbours keep their results.
"""

from __future__ import annotations

import atexit
import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Module under which a worker keeps its resources: it outlives the functions of a task.
HOLDER = "tonewell_worker_resources"


def held(identity: str, opener: Callable[[], Any]) -> Any:
    """The worker's resource of this identity; ``opener`` makes it on first use.

    A resource with a ``close`` method is closed when the worker ends.
    """
    holder = sys.modules.setdefault(HOLDER, types.ModuleType(HOLDER))
    opened = holder.__dict__.setdefault("opened", {})
    if identity not in opened:
        opened[identity] = opener()
        if hasattr(opened[identity], "close"):
            atexit.register(opened[identity].close)
    return opened[identity]


def embed_with(
    opener: Callable[[], Any],
    embed: Callable[[Any, list], Sequence],
    key: str = "path",
    batch_rows: int = 256,
) -> Callable[[DataFrame], DataFrame]:
    """A ``compute`` for ``embedding_cache``: (key, embedding, error) of each key.

    ``embed(resource, keys)`` gives one vector per key, for ``batch_rows`` keys at most. The
    opener travels to the workers as it is, and its bytes tell resources apart. If it fails, so
    does the task, which Spark tries again; a key whose vector fails is a row with ``error``.
    """
    identity = hashlib.sha1(cloudpickle.dumps(opener)).hexdigest()

    def one_by_one(resource, keys: list) -> list[tuple]:
        out = []
        for value in keys:
            try:
                (vector,) = embed(resource, [value])
                out.append((value, vector, None))
            except Exception as exc:
                out.append((value, None, f"{type(exc).__name__}: {exc}"))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = held(identity, opener)
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                keys = batch[key].iloc[at : at + batch_rows].tolist()
                try:
                    vectors = list(embed(resource, keys))
                    if len(vectors) != len(keys):
                        raise ValueError(f"{len(vectors)} vectors for {len(keys)} keys")
                    rows = [(k, v, None) for k, v in zip(keys, vectors, strict=True)]
                except Exception:
                    rows = one_by_one(resource, keys)
                yield pd.DataFrame(rows, columns=[key, "embedding", "error"])

    def compute(keys: DataFrame) -> DataFrame:
        kind = keys.schema[key].dataType.simpleString()
        return keys.select(key).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, error string")

    return compute
