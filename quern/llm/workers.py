"""What a Python worker keeps from one task to the next, and what it gives back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_held: dict = {}


def held(name: str, make: Callable):
    """An object that all tasks of one kind share in a worker. The next kind's first task lets go of it, so that a worker that lives through many stages has one at most."""
    if name not in _held:
        _held.clear()
        trim()
        _held[name] = make()
    return _held[name]


def trim() -> None:
    """Give freed memory back to the system, as an executor's limit counts what its workers hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function for ``mapInArrow`` that trims its worker at a task's start and end."""

    @functools.wraps(f)
    def run(batches):
        trim()
        yield from f(batches)
        trim()

    return run


def values(array: pa.Array) -> list:
    """An Arrow array of texts or bytes, or of numbers without nulls, as a list; much faster than ``to_pylist``, which makes a scalar of each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def rows_of(data: bytes | memoryview | pa.Buffer, ends) -> pa.Array:
    """A binary array of the bytes up to each end, without a Python object for each."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(keys))[: len(first)]


def packed(records: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Fixed-size records as one binary value for each bucket in ``where``, and the buckets."""
    order = np.argsort(where, kind="stable")
    first, ends = runs(where[order])
    return where[order][first], rows_of(records[order].tobytes(), ends * records.dtype.itemsize)


def bucket_count(spark: SparkSession) -> int:
    """A few buckets for each partition of a shuffle, a power of two."""
    return 1 << (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
