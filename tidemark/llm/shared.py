"""What several operators need: bounded batches, free names, folds, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import materialize, shared_dir, shuffles_dropped  # noqa: F401  for the operators here


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, as many at a time as hold about ``size`` bytes in ``column`` (one at least); the
    memory of the rows before is given back to the machine."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(length) // size
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for start, stop in zip(starts, starts[1:], strict=False):
            if start < stop:
                yield batch.slice(start, stop - start)
        give_back()
    give_back()


def give_back() -> None:
    """A worker lives on after its task; what it has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def by_size(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most ``rows`` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id) -> F.Column:
    """The fold that no fit may see."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
