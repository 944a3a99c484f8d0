"""Cleaning (P1, P3, P4, P5) and the cleaning audit.

The audit folds what the reference runs as separate scans (count before,
count after, five filter counts) into a single aggregate over the source: one
scan, map-side partial counts, one tiny shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import (CLEAN_MIN_DATE, CLEAN_PRIX_RANGE, CLEAN_QUANTITE_RANGE,
                                CLEAN_SALE_TYPE, DROPPED_COLUMNS)
from tillcast.functions.scalars import pct


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All columns but a list; names missing from the frame are ignored."""
    return df.drop(*(DROPPED_COLUMNS if names is None else names))


def clean_predicate(min_date: str = CLEAN_MIN_DATE,
                    prix_range: tuple[float, float] = CLEAN_PRIX_RANGE,
                    quantite_range: tuple[float, float] = CLEAN_QUANTITE_RANGE,
                    sale_type: str = CLEAN_SALE_TYPE, collation: str | None = None) -> Column:
    """P3 as one boolean column (null rows fail, as in SQL WHERE).

    Text equality is case-sensitive (Spark's default); ``collation`` (e.g.
    ``"UTF8_LCASE_RTRIM"``) compares like a case-insensitive MySQL collation
    that ignores trailing spaces (N8)."""
    sale = F.col("TypeVente") if collation is None else F.collate(F.col("TypeVente"), collation)
    return ((sale == sale_type)
            & F.col("Date").isNotNull()
            & (F.col("Date") >= F.lit(min_date).cast("date"))
            & F.col("Prix").between(prix_range[0], prix_range[1])
            & F.col("Quantite").between(quantite_range[0], quantite_range[1]))


def clean_sales(df: DataFrame, drop: list[str] | None = None, **bounds) -> DataFrame:
    """P1 + P3: the raw sales fact -> the cleaned sales fact."""
    return drop_columns(df, drop).filter(clean_predicate(**bounds))


def positive_sales(df: DataFrame) -> DataFrame:
    """Dated rows with positive quantity and price."""
    return df.filter(F.col("Date").isNotNull() & (F.col("Quantite") > 0) & (F.col("Prix") > 0))


def sample_rows(df: DataFrame, fraction: float = 0.10, seed: int = 42,
                keys: list[str] | None = None) -> DataFrame:
    """P5: Bernoulli sample of about ``fraction`` of the rows.

    With ``keys`` the draw is a hash of the key columns, so the same rows are
    kept whatever the partitioning or a task retry; without, Spark's seeded
    per-partition sampler is used.
    """
    if not keys:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    buckets = 1 << 30
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(buckets)) / float(buckets)
    return df.filter(u < fraction)


def filter_impact(df: DataFrame, min_date: str = CLEAN_MIN_DATE,
                  prix_range: tuple[float, float] = CLEAN_PRIX_RANGE,
                  quantite_range: tuple[float, float] = CLEAN_QUANTITE_RANGE,
                  sale_type: str = CLEAN_SALE_TYPE) -> DataFrame:
    """G1 + G4 in one pass: counts before/after, percents, and the five
    overlapping per-filter counts.  Rows with null Prix or Quantite are removed
    by P3 but not counted by the reference's five counts; they get their own
    columns (``null_prix``, ``null_quantite``) so the gap is visible."""
    keep = clean_predicate(min_date, prix_range, quantite_range, sale_type)
    d = F.col("Date")
    agg = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"),
        F.count_if((F.col("TypeVente") != sale_type) | F.col("TypeVente").isNull()).alias("n_type"),
        F.count_if(d.isNull()).alias("n_date_null"),
        F.count_if(d.isNotNull() & (d < F.lit(min_date).cast("date"))).alias("n_date_old"),
        F.count_if((F.col("Prix") < prix_range[0]) | (F.col("Prix") > prix_range[1])).alias("n_prix"),
        F.count_if((F.col("Quantite") < quantite_range[0])
                   | (F.col("Quantite") > quantite_range[1])).alias("n_quantite"),
        F.count_if(F.col("Prix").isNull()).alias("null_prix"),
        F.count_if(F.col("Quantite").isNull()).alias("null_quantite"),
    )
    return agg.withColumns({
        "rows_removed": F.col("rows_before") - F.col("rows_after"),
        "pct_kept": pct("rows_after", "rows_before"),
        "pct_removed": pct(F.col("rows_before") - F.col("rows_after"), "rows_before"),
    })


def quality_counts(df: DataFrame) -> DataFrame:
    """Null counts of four columns, non-positive quantity and price, total.
    A null compared with 0 counts as 0, as in SQL."""
    return df.agg(
        F.count_if(F.col("Date").isNull()).alias("date_null"),
        F.count_if(F.col("CodeArticle").isNull()).alias("article_null"),
        F.count_if(F.col("Quantite").isNull()).alias("qte_null"),
        F.count_if(F.col("Prix").isNull()).alias("prix_null"),
        F.count_if(F.col("Quantite") <= 0).alias("qte_neg_ou_zero"),
        F.count_if(F.col("Prix") <= 0).alias("prix_neg_ou_zero"),
        F.count(F.lit(1)).alias("total"),
    )


def year_distribution(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """G11 + W5: rows per year and share of all rows (rounded to 2).

    The share uses a window over the whole (small) aggregate: one row per year.
    """
    per_year = df.groupBy(F.year(date_col).alias("annee")).agg(F.count(F.lit(1)).alias("nb_lignes"))
    total = F.sum("nb_lignes").over(Window.partitionBy())
    return per_year.withColumn("pourcentage", pct(F.col("nb_lignes"), total))
