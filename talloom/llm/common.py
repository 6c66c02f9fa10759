"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.session import configure, reliable, shared_dir

#: ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of one Arrow batch; a batch of long texts must not grow with the number of rows.
ARROW_BYTES = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on: bounded Arrow batches and a shared folder."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shared_dir(spark)
    return spark


def give_back() -> None:
    """Hand freed memory of this process back to the system.

    Python workers live on between tasks and stages; what the allocators keep of one stage would stand beside the next.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder instead of the plan so far."""
    return reliable(df, name)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`, also within higher-order functions."""
    return F.get(F.transform(F.array(value), body), 0)


