"""Documents from files, and back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, paths: str | list[str], column: str = "source") -> DataFrame:
    """(doc_id, path, text column): one row for each file, whatever its format; doc_id is its path.

    A missing path fails when the query is planned. Files are read whole, so
    white space and line ends stay as they are.
    """
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.input_file_name().alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias(column))


def write_documents(df: DataFrame, path: str, column: str = "source") -> None:
    """(doc_id, column) as Parquet."""
    df.select("doc_id", column).write.parquet(path)
