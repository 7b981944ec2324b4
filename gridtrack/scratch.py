"""Shared scratch tables: the way plans are cut without machine-local files.

A long plan is cut by writing it as Parquet below ``spark.checkpoint.dir`` (a folder that the
driver and all executors see) and reading it back, so that a lost executor costs a re-read and
not a recomputation of the whole lineage.  Where the setting is missing, as in tests on one
machine, a folder below the warehouse is used.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named by the session, or one below the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return where.rstrip("/")


def table(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder, in folders by a column if given, and return the table that was written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver notice plans that are done, so that their shuffle files go; many stages in a row need it."""
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for where in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]+$", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
