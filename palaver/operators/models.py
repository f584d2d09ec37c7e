"""Models held by worker processes, and batches of texts of like length.

A worker process outlives its tasks.  A model loaded in one task is kept for the next ones,
under a key taken from the pickled factory, so that a job of many small tasks loads it once
per process.  Only the models used last are kept.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark import cloudpickle

# Models that a process keeps at a time.
HELD = 2
_held: OrderedDict[str, Any] = OrderedDict()


def factory_key(factory: Callable[[], Any]) -> str:
    """What tells a factory from others: its code and all it refers to."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def model_of(key: str, factory: Callable[[], Any], held: int = HELD) -> Any:
    """The factory's model, loaded if this process does not hold it.

    A factory that raises leaves nothing behind.
    """
    if key in _held:
        _held.move_to_end(key)
        return _held[key]
    while len(_held) >= held:
        # Before loading, so that no more than that many are in memory.
        _held.popitem(last=False)
    _held[key] = factory()
    return _held[key]


def forget_models() -> None:
    """Drop what this process holds."""
    _held.clear()


def by_length(texts: Sequence[str | None], batch_size: int) -> Iterator[list[int]]:
    """Places of the texts in batches of like length, longest first.

    A padded batch costs as much as its longest text times its size, so long texts should
    meet long ones.  Null counts as empty; equal lengths keep their order.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    for start in range(0, len(order), batch_size):
        yield order[start : start + batch_size]


def predictions(
    predict: Callable[[list], Sequence], texts: Sequence[str | None], batch_size: int
) -> list:
    """One result per text, in the texts' order, from batches of like length."""
    out: list = [None] * len(texts)
    for places in by_length(texts, batch_size):
        found = predict([texts[i] for i in places])
        found = found.tolist() if hasattr(found, "tolist") else list(found)
        if len(found) != len(places):
            raise ValueError("the model must return one result per text")
        for i, result in zip(places, found, strict=True):
            out[i] = result
    return out
