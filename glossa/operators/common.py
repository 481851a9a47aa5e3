"""Join hints behind a size check, checkpoints, and the size of batches to workers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch on its way to a worker, about.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to workers hold about BATCH_BYTES, unless the session says otherwise: ten thousand
    long texts would fill memory twice, in the executor and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has no more rows than the limit; the table itself otherwise."""
    return F.broadcast(df) if few(df, limit) else df


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to ``spark.checkpoint.dir`` and read back, so plans stay short and lost executors don't matter.

    Only where that is unset (tests, one machine) a temporary folder is used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="glossa-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
