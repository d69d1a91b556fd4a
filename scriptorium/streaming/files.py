"""A stream of files.

Documents don't depend on each other, so the operators over documents are
stateless on a stream: no watermark and no state store. The relational plans
use windows over a document, which streams don't have; apply them to each
micro-batch with ``each_batch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_documents(spark: SparkSession, path: str, column: str = "source", files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, text column) of files as they arrive in a folder."""
    text = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return text.select(F.input_file_name().alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias(column))


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append plan(documents) of every micro-batch to Parquet; ends when all that is there is done."""

    def write(batch: DataFrame, _: int) -> None:
        plan(batch).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
