"""Boundaries inside long projections and between the steps of an operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Rows of a batch that a Python worker is sent, and rows whose results it holds at a time.
BATCH_ROWS, SLICE_ROWS = 512, 64
#: Rows of a table that one task is dealt.
TASK_ROWS = 250_000


def step(df: DataFrame, name: str) -> DataFrame:
    """Counts the rows that pass as an observed metric.

    Filters and projections are not folded through an observation, so what stands above reads the computed columns
    instead of repeating their expressions, which would multiply at every further step.
    """
    return df.observe(f"{name}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by key over as many tasks as their count asks for, so that a task's memory does not grow with the
    table. They are counted first: cheap for a table read from files, whose footers hold the count."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *by)


def _shared(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gleanery-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are removed as it ends, instead of when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, given)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps read only the columns they need, and lost executors
    cost no more than the step at hand."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave, when all that is made of them is written itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def map_pages(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` over rows that are whole pages: a worker gets small batches and returns the results of a few pages
    before it goes on, so that its memory does not grow with a task's pages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), SLICE_ROWS):
                yield from run(iter([rows.iloc[at : at + SLICE_ROWS].reset_index(drop=True)]))

    return df.mapInPandas(sliced, schema)
