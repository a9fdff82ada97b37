"""Helpers of the operators that work on Arrow batches in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of the batches with the texts of column (null: ""); a slice holds most bytes of text or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        ends = np.cumsum(size)
        begin, base = 0, 0
        while begin < len(size):
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(begin, end - begin)
            yield part, [t or "" for t in part.column(at).to_pylist()]
            begin, base = end, int(ends[end - 1])


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the Arrow batches between the JVM and Python by bytes, as a worker holds several of them at once.

    A session's own smaller bound stays. Spark's own bound is 64 MB, and 10,000 rows, whatever their texts' size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (None, "67108864b", "64m"):
        spark.conf.set(key, most)


def tidy() -> None:
    """Give memory that a task has freed back to the system: idle Python workers stay, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, text: str, function: Callable[[pa.RecordBatch, list[str]], dict[str, pa.Array]], schema: str, most: int = 1_000_000, keep_text: bool = True) -> DataFrame:
    """df's columns (the text itself only with keep_text) with function's columns, worked out slice by slice.

    function's columns are those of schema; they replace any of the same name.
    """
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    new = StructType.fromDDL(schema)
    names = {f.name for f in new.fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]
    out = StructType(kept + new.fields)
    order = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, most):
            made = function(part, texts)
            own = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(own + [made[n] for n in order], names=[f.name for f in kept] + order)
        tidy()

    return df.mapInArrow(run, out)


class Numbers(dict):
    """Numbers for keys, in the order in which they are first asked for."""

    def __missing__(self, key: object) -> int:
        self[key] = number = len(self)
        return number


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; an empty run sums to zero. Works along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
