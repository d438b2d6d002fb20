"""Staging for texts: the shared folder and checked broadcasts of the library, and Arrow batches of bounded bytes."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

from facetline.operators.staging import materialise, shared_dir, small_side

__all__ = ["in_batches", "materialise", "shared_dir", "small_side"]

#: Bytes of a batch of texts that goes to a Python worker; one row at least.
BATCH_BYTES = "4m"


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches that are bounded in bytes, as rows of long texts are not. The bound is set for the session.

    Python workers serve one task after the other; each gives its memory back when its task ends.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return df.mapInArrow(tidy, schema)
