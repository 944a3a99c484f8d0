"""Sinks (S4-S6) and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  sort_within: list[str] | None = None) -> None:
    """Create-or-replace a table as Parquet (``CREATE TABLE AS``, drop if exists).

    ``partition_by`` gives directory partitions (e.g. year) for later pruning;
    ``sort_within`` sorts rows inside each file (K9: the reference's full sort
    by keys is only needed here, windows sort their own partitions) so min/max
    statistics skip row groups.  The write is one job; a lost executor re-runs only its tasks.
    """
    writer_df = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = writer_df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Many named result tables, one Parquet folder per name."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def schema_table(spark: SparkSession, df: DataFrame, primary_key: str | None = None) -> DataFrame:
    """(COLUMN_NAME, DATA_TYPE, IS_NULLABLE, COLUMN_KEY, ORDINAL_POSITION) of a frame.

    Built from ``df.schema`` on the driver: its size is the column count.
    """
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO",
             "PRI" if primary_key and f.name == primary_key else "", i + 1)
            for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([
        T.StructField("COLUMN_NAME", T.StringType()),
        T.StructField("DATA_TYPE", T.StringType()),
        T.StructField("IS_NULLABLE", T.StringType()),
        T.StructField("COLUMN_KEY", T.StringType()),
        T.StructField("ORDINAL_POSITION", T.IntegerType()),
    ])
    return spark.createDataFrame(rows, schema)


def schema_counts(df: DataFrame, primary_key: str | None = None) -> DataFrame:
    """S7 with the data behind it: the rows of ``schema_table`` plus the number of
    rows and of nulls of every column, from one aggregate of the whole table."""
    names = [f.name for f in df.schema.fields]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(f.name).alias("COLUMN_NAME"), F.lit(f.dataType.simpleString()).alias("DATA_TYPE"),
                     F.lit("YES" if f.nullable else "NO").alias("IS_NULLABLE"),
                     F.lit("PRI" if primary_key and f.name == primary_key else "").alias("COLUMN_KEY"),
                     F.lit(i + 1).alias("ORDINAL_POSITION"), F.col("_n").alias("ROW_COUNT"),
                     (F.col("_n") - F.col(f"_c{i}")).alias("NULL_COUNT")) for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*rows)))


def feature_counts(df: DataFrame, top: dict[str, int | None]) -> DataFrame:
    """``(column, value, count)``: the ``n`` most frequent values of each column
    of ``top`` (all for ``None``), ties by value; nulls are left out.

    One aggregate over all the columns together serves every column.
    """
    cols = list(top)
    together = df.groupBy(*[F.col(c).cast("string").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("count"))
    each = (together.unpivot(["count"], cols, "column", "value").filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.sum("count").alias("count")))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    most = F.lit(False)
    for c, n in top.items():
        most = most | ((F.col("column") == c) & (F.lit(True) if n is None else F.col("_place") <= n))
    return each.withColumn("_place", place).filter(most).drop("_place")


def table_check(spark: SparkSession, name: str, df: DataFrame | None = None) -> DataFrame:
    """Does a catalog table exist, and how many rows it (or ``df``) has."""
    exists = spark.catalog.tableExists(name)
    source = df if df is not None else (spark.table(name) if exists else None)
    if source is None:
        return spark.createDataFrame([(name, False, None)],
                                     "table string, exists boolean, row_count bigint")
    return source.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table"), F.lit(True).alias("exists"), "row_count")


def feature_summary(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """One row: row count, column list, date min/max (one aggregate)."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
    ).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))
