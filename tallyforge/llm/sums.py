"""Sums over all rows of a table of arrays that are too large for one row."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.runtime import checkpointed

#: Cells of an array that are added up together.
PAGE = 1 << 14
_COLUMNS = "name string, page int, cell binary, value binary, kind string"


_SCHEMA = pa.schema([("name", pa.string()), ("page", pa.int32()), ("cell", pa.binary()), ("value", pa.binary()), ("kind", pa.string())])


def pages(name: str, whole: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The cells of an array that are not 0, in pages, as rows of _COLUMNS."""
    flat = whole.reshape(-1)
    for at in range(0, len(flat), PAGE):
        value = flat[at : at + PAGE]
        cell = np.flatnonzero(value)
        if len(cell):
            value = value[cell]
            small = value.astype(np.float32)
            value = small if (small == value).all() else value
            yield pa.RecordBatch.from_pylist([{"name": name, "page": first + at // PAGE, "cell": cell.astype(np.int32).tobytes(), "value": value.tobytes(), "kind": value.dtype.str}], _SCHEMA)


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The sums over all tasks of the named arrays that ``work`` makes of the rows of a task.

    Only cells that are not 0 are sent, in pages that are added up by as many
    tasks as there are pages; the driver gets each sum once, whatever the size
    of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, whole in work(batches).items():
            yield from pages(name, whole)

    return added(df.mapInArrow(run, _COLUMNS), shapes)


def summed_and_kept(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[dict[str, np.ndarray], object]]], shapes: dict[str, tuple[int, ...]]) -> tuple[dict[str, np.ndarray], DataFrame]:
    """The same where ``work`` gives arrays part by part, with something to keep of each; and the table of what is kept, for :func:`kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros(shape) for name, shape in shapes.items()}
        for arrays, keep in work(batches):
            for name, found in arrays.items():
                total[name] += found
            raw = pickle.dumps(keep, 5)
            yield pa.RecordBatch.from_pylist([{"name": None, "page": len(raw), "cell": None, "value": pa.compress(raw, "zstd", asbytes=True), "kind": None}], _SCHEMA)
        for name, whole in total.items():
            yield from pages(name, whole)

    every = checkpointed(df.mapInArrow(run, _COLUMNS))
    return added(every.where("name is not null"), shapes), every.where("name is null").select("page", "value")


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[object]:
    for r in chain.from_iterable(b.to_pylist() for b in batches):
        yield pickle.loads(pa.decompress(r["value"], r["page"], "zstd", asbytes=True))


def added(paged: DataFrame, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The sums of rows of _COLUMNS."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                np.add.at(total.setdefault((r["name"], r["page"]), np.zeros(PAGE)), np.frombuffer(r["cell"], np.int32), np.frombuffer(r["value"], r["kind"]))
        for (name, page), whole in total.items():
            yield from pages(name, whole, page)

    out = {name: np.zeros(-(-int(np.prod(shape)) // PAGE) * PAGE) for name, shape in shapes.items()}
    for r in paged.repartition("name", "page").mapInArrow(add, _COLUMNS).collect():
        out[r.name][r.page * PAGE + np.frombuffer(r.cell, np.int32)] = np.frombuffer(r.value, r.kind)
    return {name: out[name][: int(np.prod(shape))].reshape(shape) for name, shape in shapes.items()}
