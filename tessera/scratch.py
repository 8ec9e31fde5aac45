"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the application below ``spark.checkpoint.dir``."""
    return f"{scratch_base(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again, so that what reads it twice does not compute it twice and a lost executor costs a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of at most so many narrow rows is broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Rows of an Arrow batch of whole texts. Spark's own 10,000 are held in the JVM and again in Python.
TEXT_ROWS = 512
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What runs inside hands Python at most ``rows`` rows at a time; the session's setting is put back after it."""
    with _at_most(spark, _BATCH_ROWS, rows):
        yield


@contextmanager
def list_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """The same for rows of long lists, which the Parquet reader also holds only so many of at a time (4,096 otherwise)."""
    with text_batches(spark, rows), _at_most(spark, _READ_ROWS, rows):
        yield


@contextmanager
def _at_most(spark: SparkSession, name: str, rows: int) -> Iterator[None]:
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
