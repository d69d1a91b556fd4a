"""Intermediate tables in storage that all executors share, and columns as the operators take them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from scriptorium.functions.spread import spread

#: Rows up to which a table of a few numbers a row is broadcast instead of shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/scriptorium-{os.getpid()}"
    return f"{named.rstrip('/')}/scriptorium/{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there.

    A lost executor then costs no more than rereading a file. The table stays
    until drop(), or clear() after the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(kept: DataFrame) -> None:
    """Delete what keep() wrote; nothing may read it any more."""
    _delete(kept.sparkSession, kept._kept_at)


def clear(spark: SparkSession) -> None:
    """Delete all that keep() wrote in this application; call it when the results are written."""
    _delete(spark, shared_dir(spark))


def small(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it, or ``rows``, which has no fewer rows, is small."""
    return F.broadcast(df) if (df if rows is None else rows).count() <= BROADCAST_ROWS else df


def id_of(df: DataFrame, name: str) -> Column:
    """An id column: whole numbers as long, other types as they are."""
    return F.col(f"`{name}`").cast("long") if isinstance(df.schema[name].dataType, IntegralType) else F.col(f"`{name}`")


def join_keys(a: DataFrame, b: DataFrame, name: str) -> list[Column]:
    """Of either table its id column, as long if both are whole numbers, else as string."""
    whole = all(isinstance(df.schema[name].dataType, IntegralType) for df in (a, b))
    return [id_of(df, name) if whole else F.col(f"`{name}`").cast("string") for df in (a, b)]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table with any other columns."""
    return spread(docs.select(id_of(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))


def with_id(df: DataFrame, more: str, name: str = "doc_id") -> StructType:
    """A schema of df's id column, whatever its type, and more columns."""
    return StructType([StructField(name, df.schema[name].dataType), *StructType.fromDDL(more)])
