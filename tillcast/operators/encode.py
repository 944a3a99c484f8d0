"""Category codes (X10) and code lookups.

A code is the position of a value among the sorted distinct values (code
point order for text, numeric order for numbers), null gets -1 (pandas
``cat.codes``).  The code table is built once from the distinct values and
reused for training and scoring, so one family never gets two codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialize


# a code table of at most this many bytes (values and 16 a row) is broadcast
BROADCAST_BYTES = 32 << 20


def code_table(df: DataFrame, col: str, code_col: str | None = None, partitions: int | None = None) -> DataFrame:
    return code_table_sized(df, col, code_col, partitions)[0]


def code_table_sized(df: DataFrame, col: str, code_col: str | None = None,
                     partitions: int | None = None) -> tuple[DataFrame, int]:
    """(value, code) for the distinct non-null values of ``col``, and its size in bytes.

    ``distinct`` is a partial aggregate, so only distinct values are shuffled.
    They are range-partitioned and sorted inside each partition, written once
    to the checkpoint folder, and each partition adds the count of the
    partitions before it (one row per partition comes back to the driver), so
    no task holds more than its range of values, whatever their number.
    """
    code_col = code_col or f"{col}_encoded"
    spark = df.sparkSession
    distinct = df.select(col).filter(F.col(col).isNotNull()).distinct()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(distinct.repartitionByRange(n, col).sortWithinPartitions(col)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_pos", F.monotonically_increasing_id()))
    counts = sorted(ordered.groupBy("_pid").agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(col).cast("string"))))
                    .collect())
    offsets, total, size = [], 0, 0
    for pid, cnt, length in counts:
        offsets.append((pid, total))
        total += cnt
        size += length + 16 * cnt
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    # monotonically_increasing_id = partition id << 33 + position in partition
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ordered.join(F.broadcast(off), "_pid")
            .select(col, (F.col("_off") + local).cast("int").alias(code_col))), size


def broadcast_measured(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, written once and measured: with a broadcast hint if its values
    take at most ``limit`` bytes (16 a row and column, and its texts), else without."""
    table = materialize(table)
    texts = [F.octet_length(F.col(c)) for c, t in table.dtypes if t == "string"]
    size = F.lit(16 * len(table.columns)) + sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0))
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= limit else table


def encode(df: DataFrame, col: str, table: DataFrame | None = None,
           code_col: str | None = None) -> DataFrame:
    """Add ``<col>_encoded``; null or unknown values get -1.

    A code table built here is broadcast if it measures at most
    ``BROADCAST_BYTES``.  A larger or given one is joined without a hint: AQE
    broadcasts it if it is small and splits a hot value's partition otherwise.
    """
    code_col = code_col or f"{col}_encoded"
    if table is None:
        table, size = code_table_sized(df, col, code_col)
        table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    joined = df.join(table, on=col, how="left")
    return joined.withColumn(code_col, F.coalesce(F.col(code_col), F.lit(-1)).cast("int"))


def encode_many(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = encode(df, c)
    return df


def lookup(df: DataFrame, table: DataFrame, col: str, code_col: str) -> tuple[DataFrame, DataFrame]:
    """Value -> code; rows whose value is not in the table go to a second
    frame (the rejects) instead of getting a code."""
    marked = df.join(table.withColumn("_known", F.lit(True)), on=col, how="left")
    known = marked.filter(F.col("_known").isNotNull()).drop("_known")
    unknown = marked.filter(F.col("_known").isNull()).drop("_known", code_col)
    return known, unknown
