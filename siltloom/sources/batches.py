"""Arrow batches of bounded bytes: what a Python task holds doesn't hang on how long the texts are or how many rows a batch may have."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

#: Bytes of text that a Python task handles at a time.
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about SLICE_BYTES of text (one row at least), so that long texts don't fill memory."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= SLICE_BYTES or n <= 1:
            if n:
                yield batch
            continue
        column = batch.column(text)
        length = pa.compute.list_value_length if pa.types.is_list(column.type) else pa.compute.binary_length
        sizes = np.asarray(length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) * (8 if pa.types.is_list(column.type) else 1) + 64
        ends, at = np.cumsum(sizes), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def byte_count(value: str) -> int:
    """A setting of bytes such as ``8m``, ``64MB``, ``1KiB`` or ``8388608b`` as a number."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", value).groups()
    return int(number) * _UNITS[unit.lower().removesuffix("b").removesuffix("i")]


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of the session's Arrow batches, as long texts and sets would fill the Python workers. Results are lazy and read the
    setting when they run, so that it stays; a smaller one of the user's is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = byte_count(spark.conf.get(key))
    if now > BATCH_BYTES or now <= 0:
        spark.conf.set(key, str(BATCH_BYTES))
