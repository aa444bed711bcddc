"""Count sketches of fixed size, added up over all tasks: rows (n: slice, payload) of packed 32-bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SLICES = 16


def press(sketch: np.ndarray) -> list[bytes]:
    """The payloads of a sketch's slices, in order."""
    return [zstandard.compress(s.tobytes(), 1) for s in np.split(sketch, SLICES)]


def _add(n: list[int], payload: list[bytes], sums: dict[int, np.ndarray]) -> None:
    for k, x in zip(n, payload, strict=True):
        s = np.frombuffer(zstandard.decompress(x), np.uint32)
        sums[k] = np.minimum(sums[k].astype(np.uint64) + s, 2**32 - 1).astype(np.uint32) if k in sums else s


def summed(rows: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches: tasks add up what they read, then slices are added up."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            _add(b.column(0).to_pylist(), b.column(1).to_pylist(), sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zstandard.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["n", "payload"])

    def finish(table: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        _add(table["n"].to_pylist(), table["payload"].to_pylist(), sums)
        return pa.table([pa.array(list(sums), pa.int64()), pa.array([zstandard.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["n", "payload"])

    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for k, x in rows.mapInArrow(combine, "n long, payload binary").groupBy("n").applyInArrow(finish, "n long, payload binary").collect():
        out[k] = np.frombuffer(zstandard.decompress(x), np.uint32)
    return out.reshape(-1)
