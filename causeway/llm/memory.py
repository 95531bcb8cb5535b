"""Memory of tasks with Python workers: small batches, and what a batch needed goes back to the system before the next one."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Rows and bytes of a batch on its way to or from a Python worker. A longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Hold batches to ``BATCH``: by default 10,000 texts go at once, however long they are."""
    for key, most in BATCH.items():
        spark.conf.set(key, str(most))


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def trimmed(batches: Iterable[T]) -> Iterator[T]:
    """The batches of a task. A worker lives on between tasks, beside the executor's own memory."""
    for batch in batches:
        yield batch
        del batch
        trim()
    trim()
