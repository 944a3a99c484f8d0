"""Sale date against reception date.

The scalar subqueries of the reference (a count over the whole table used as a
denominator) become one extra aggregate column or a one-row frame joined by
broadcast: one row has a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import RECEPTION_RANGE
from tillcast.functions.scalars import day_gap, pct


def both_present(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Date").isNotNull() & F.col("Reception").isNotNull())


def both_present_and_different(df: DataFrame) -> DataFrame:
    """P6."""
    return both_present(df).filter(F.col("Date") != F.col("Reception"))


def null_overview(df: DataFrame) -> DataFrame:
    """Rows, null Date / Reception counts and percents."""
    agg = df.agg(
        F.count(F.lit(1)).alias("total_lignes"),
        F.count_if(F.col("Date").isNull()).alias("date_null"),
        F.count_if(F.col("Reception").isNull()).alias("reception_null"),
    )
    return agg.withColumns({
        "pct_date_null": pct("date_null", "total_lignes"),
        "pct_reception_null": pct("reception_null", "total_lignes"),
    })


def different_rows(df: DataFrame) -> DataFrame:
    """Rows where both dates exist and differ, and their share of all rows.
    One pass: the numerator is a conditional count next to the total."""
    diff = F.col("Date").isNotNull() & F.col("Reception").isNotNull() & (F.col("Date") != F.col("Reception"))
    agg = df.agg(F.count_if(diff).alias("lignes_differentes"),
                 F.count(F.lit(1)).alias("_total"))
    return agg.select("lignes_differentes",
                      pct("lignes_differentes", "_total").alias("pct_differentes"))


def gap_stats(df: DataFrame) -> DataFrame:
    """Mean absolute gap, min and max signed gap in days."""
    gap = day_gap("Date", "Reception")
    return both_present(df).agg(
        F.avg(F.abs(gap).cast("double")).alias("ecart_moyen_jours"),
        F.min(gap).alias("ecart_min_jours"),
        F.max(gap).alias("ecart_max_jours"),
    )


def gap_distribution(df: DataFrame, top: int = 20) -> DataFrame:
    """G15 + J3 + K1: the ``top`` most frequent gaps with count and percent of
    both-present rows.  Ties on the count are broken by the gap value."""
    per_gap = both_present(df).groupBy(day_gap("Date", "Reception").alias("ecart_jours")).agg(
        F.count(F.lit(1)).alias("nb_lignes"))
    # the total is a sum over one row per gap (days between two dates), so the fact is read once
    total = F.sum("nb_lignes").over(Window.partitionBy())
    return (per_gap.withColumn("_n", total)
            .select("ecart_jours", "nb_lignes", pct("nb_lignes", "_n").alias("pourcentage"))
            .orderBy(F.desc("nb_lignes"), F.asc("ecart_jours"))
            .limit(top))


def gap_examples(df: DataFrame, n: int = 20, id_cols: tuple[str, ...] = ("l_orderkey", "l_linenumber")) -> DataFrame:
    """K5: ``n`` example rows where the dates differ.  The reference takes any
    ``n``; here the order covers every output column so the pick is stable."""
    out = both_present_and_different(df).select(
        *id_cols, "Date", "Reception", day_gap("Date", "Reception").alias("ecart_jours"),
        "TypeVente", "Famille", "Prix")
    return out.orderBy(*out.columns).limit(n)


def null_share_by_year(df: DataFrame, reception_range: tuple[str, str] = RECEPTION_RANGE) -> DataFrame:
    """G16 + P7: per reception year inside the range, rows and null-Date share."""
    lo, hi = reception_range
    rec = F.col("Reception")
    inside = df.filter((rec >= F.lit(lo).cast("date")) & (rec <= F.lit(hi).cast("date")))
    agg = inside.groupBy(F.year(rec).alias("annee")).agg(
        F.count(F.lit(1)).alias("total_lignes"),
        F.count_if(F.col("Date").isNull()).alias("date_null"))
    return agg.withColumn("pct_date_null", pct("date_null", "total_lignes"))


def date_summary(df: DataFrame) -> DataFrame:
    """G12 + G13 + G14 in one scan: null counts and percents, differing rows
    and their share, and the gap statistics over rows with both dates.  The
    reference runs these as three queries over the table."""
    both = F.col("Date").isNotNull() & F.col("Reception").isNotNull()
    gap = day_gap("Date", "Reception")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_lignes"),
        F.count_if(F.col("Date").isNull()).alias("date_null"),
        F.count_if(F.col("Reception").isNull()).alias("reception_null"),
        F.count_if(both & (F.col("Date") != F.col("Reception"))).alias("lignes_differentes"),
        F.avg(F.when(both, F.abs(gap)).cast("double")).alias("ecart_moyen_jours"),
        F.min(F.when(both, gap)).alias("ecart_min_jours"),
        F.max(F.when(both, gap)).alias("ecart_max_jours"),
    )
    return agg.withColumns({
        "pct_date_null": pct("date_null", "total_lignes"),
        "pct_reception_null": pct("reception_null", "total_lignes"),
        "pct_differentes": pct("lignes_differentes", "total_lignes"),
    })
