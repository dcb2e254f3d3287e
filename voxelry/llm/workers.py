"""Running array functions in Python workers, with bounded batches and no memory kept."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

#: Bytes of one Arrow batch between Spark and Python: each task holds a few of them.
BATCH_BYTES = 6 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which gives its memory back to the system at the end of a task.

    Python workers live on from stage to stage, and what they keep adds up.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        try:
            yield from run(batches)
        finally:
            W.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, in tasks that keep no memory."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH, str(64 << 20))) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(run), schema)
