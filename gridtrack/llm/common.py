"""What the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gridtrack import scratch

__all__ = ["documents", "forget", "kept", "parts", "read", "rows", "scratch", "tidy"]

_kept: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def rows(schema: pa.Schema, most: int = 20_000) -> tuple[list[list], Callable[[], Iterator[pa.RecordBatch]]]:
    """Column buffers and a flush that yields them as record batches and empties them."""
    columns: list[list] = [[] for _ in schema]

    def flush() -> Iterator[pa.RecordBatch]:
        n = len(columns[0])
        for lo in range(0, n, most):
            yield pa.record_batch([pa.array(c[lo : lo + most], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for c in columns:
            c.clear()

    return columns, flush


def parts(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of about ``most_bytes`` each (one long text may be more)."""
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most_bytes:
            yield lo, i
            lo, size = i, 0
        size += n or 0
    if lo < len(texts):
        yield lo, len(texts)


def kept(key, make: Callable):
    """What ``make`` gives, kept by this worker for its next task that asks for ``key``; one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    _kept.clear()


def forget(sent) -> None:
    """Let go of a broadcast's value where it can be read again from disk."""
    if getattr(sent, "_path", None) is not None and hasattr(sent, "_value"):
        del sent._value


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def tidy(run: Callable, keep: bool = False) -> Callable:
    """``run`` of a mapInArrow whose task gives its memory back when it ends.

    Spark's Python workers go on to other stages, idle ones beside busy ones, and what each has freed
    but not given back counts as an executor's memory.  ``keep``: the task uses :func:`kept`; all
    others let that go first.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            let_go()
        yield from run(batches)
        trim()

    return whole
