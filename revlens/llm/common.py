"""What several operators share: the word pattern, and staged tables of the core."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.staging import new_path, shared_dir, stage

__all__ = ["NO_ID", "WORD", "new_path", "release_memory", "shared_dir", "small_batches", "stage", "table", "text_of"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python BATCH_ROWS at a time at most: whole texts, of which ten thousand would be much."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release_memory() -> None:
    """Give memory that is free back to the system: the C library and Arrow keep it otherwise for as long as the process lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def text_of(col: str = "text") -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
