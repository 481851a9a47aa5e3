"""Annotation of a stream of documents.

Documents are independent of one another, so each micro-batch runs the batch plan; there is no state.
Batches are written under their number, so a batch that is tried again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(docs: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the annotations of every micro-batch to ``out/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def document_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def resume(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that an earlier run hasn't written yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")
