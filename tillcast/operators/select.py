"""Row and group selection.

Group selections are a small aggregate (one row per family) followed by a
semi join.  A top-n list has at most n rows, so it is broadcast; other family
lists are joined normally and AQE broadcasts them when they measure small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.constants import (EXCLUDED_FAMILIES, MIN_MEAN_WEEKLY_SALES, MIN_TARGET, TARGET,
                                TEST_CUT, TOP_FAMILIES)


def top_families(df: DataFrame, n: int = TOP_FAMILIES, target: str = TARGET,
                 key: str = "Famille") -> DataFrame:
    """K3: the ``n`` families with the largest target sum (pandas ``nlargest``
    after a sorted groupby: ties keep the first name in order)."""
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(target).alias("_s"))
    return sums.orderBy(F.desc("_s"), F.asc(key)).limit(n).select(key)


def keep_families(df: DataFrame, families: DataFrame, key: str = "Famille",
                  bounded: bool = False) -> DataFrame:
    """Rows whose family is in ``families``.  ``bounded=True`` states the
    list has a fixed maximum size (a top-n), which makes a broadcast safe."""
    right = F.broadcast(families) if bounded else families
    return df.join(right, on=key, how="left_semi")


def min_target(df: DataFrame, minimum: float = MIN_TARGET, target: str = TARGET) -> DataFrame:
    """P9."""
    return df.filter(F.col(target) >= minimum)


def one_country(df: DataFrame, country: str) -> DataFrame:
    """P10."""
    return df.filter(F.col("Pays") == country)


def exclude_families(df: DataFrame, names: list[str] | None = None, key: str = "Famille") -> DataFrame:
    """Drop a list of families (null families are kept, as pandas ``~isin``)."""
    names = EXCLUDED_FAMILIES if names is None else names
    return df.filter(~F.col(key).isin(names) | F.col(key).isNull()) if names else df


def high_volume(df: DataFrame, threshold: float = MIN_MEAN_WEEKLY_SALES,
                exclude: list[str] | None = None, target: str = TARGET, key: str = "Famille",
                means_before: tuple[str, str] | None = None) -> DataFrame:
    """Families whose mean target is at least the threshold, then P11.

    By default the mean is over all rows of the family, train and test
    together, as the reference does (its registered queries compare against
    that).  ``means_before=(date_col, cut)`` takes the mean over the rows
    before the test cut only, which keeps test weeks out of the selection."""
    rows = df if means_before is None else df.filter(F.col(means_before[0]) < F.lit(means_before[1]).cast("date"))
    means = rows.groupBy(key).agg(F.avg(target).alias("_m")).filter(F.col("_m") >= threshold).select(key)
    return exclude_families(keep_families(df, means, key), exclude, key)


def top_then_min(df: DataFrame, n: int = TOP_FAMILIES, minimum: float = MIN_TARGET) -> DataFrame:
    """V2 order: pick the top families first, then drop small targets."""
    return min_target(keep_families(df, top_families(df, n), bounded=True), minimum)


def min_then_top(df: DataFrame, n: int = TOP_FAMILIES, minimum: float = MIN_TARGET,
                 country: str | None = None) -> DataFrame:
    """V3 order (and V4 with ``country``): filter first, then pick the top."""
    f = min_target(one_country(df, country) if country else df, minimum)
    return keep_families(f, top_families(f, n), bounded=True)


def add_split(df: DataFrame, date_col: str, cut: str = TEST_CUT) -> DataFrame:
    """``split`` = 'train' before the cut, 'test' from it on; rows without a date are on neither side."""
    return df.filter(F.col(date_col).isNotNull()).withColumn(
        "split", F.when(F.col(date_col) < F.lit(cut).cast("date"), F.lit("train")).otherwise(F.lit("test")))


def split_counts(df: DataFrame, date_col: str, cut: str = TEST_CUT) -> DataFrame:
    """Rows and date range of each side of the split."""
    return (add_split(df, date_col, cut).groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("date_min"),
                 F.max(date_col).alias("date_max")))


def group_sizes(df: DataFrame, date_col: str, cut: str = TEST_CUT, min_train: int = 10,
                min_test: int = 1, key: str = "Famille") -> DataFrame:
    """Per family, train and test row counts and whether it passes the guard."""
    before = F.col(date_col) < F.lit(cut).cast("date")
    sizes = df.groupBy(key).agg(F.count_if(before).alias("train_rows"),
                                F.count_if(~before).alias("test_rows"))
    return sizes.withColumn("kept", (F.col("train_rows") >= min_train) & (F.col("test_rows") >= min_test))


def guard_groups(df: DataFrame, date_col: str, cut: str = TEST_CUT, min_train: int = 10,
                 min_test: int = 1, key: str = "Famille") -> DataFrame:
    """Keep only the rows of families passing the size guard."""
    kept = group_sizes(df, date_col, cut, min_train, min_test, key).filter("kept").select(key)
    return keep_families(df, kept, key)


def value_counts_top(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """K4: the ``n`` most frequent values, nulls left out, ties by value."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)).limit(n))
