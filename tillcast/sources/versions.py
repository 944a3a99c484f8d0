"""Versioned tables (S4, M12): staged folders behind a committed pointer.

A version is written whole into a folder of its own; one row in ``commits``
(version, folder, row count) then makes it visible.  A write that fails before
that row leaves the newest committed version as it was, and readers that
already planned on an older version keep its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "folder string, row_count bigint, version int"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def history(spark: SparkSession, root: str) -> DataFrame:
    """``(version, folder, row_count)`` of the committed versions; no rows before the first."""
    commits = f"{root.rstrip('/')}/commits"
    if not path_exists(spark, commits):
        return spark.createDataFrame([], COMMIT_SCHEMA).select("version", "folder", "row_count")
    return spark.read.schema(COMMIT_SCHEMA).parquet(commits).select("version", "folder", "row_count")


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None,
            sort_within: list[str] | None = None) -> int:
    """Write ``df`` as the next version of the table at ``root``; returns its number (from 1).

    The commit folder carries the version number and must not exist, so of two
    writers that take the same number the second gets an error.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    rows = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = rows.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{folder}")
    version = (history(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    commit = (spark.read.schema(df.schema).parquet(f"{root}/{folder}").agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(folder).alias("folder"), "row_count"))
    commit.write.mode("errorifexists").parquet(f"{root}/commits/version={version}")
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version, by default the newest; an unknown one is an error."""
    found = history(spark, root)
    if version is not None:
        found = found.filter(F.col("version") == version)
    newest = found.agg(F.max_by("folder", "version")).first()[0]
    if newest is None:
        raise ValueError(f"no committed version {'' if version is None else version} at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{newest}")
