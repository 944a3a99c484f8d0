"""Aggregated marts and EDA tables.

Every mart is a ``groupBy().agg()``: Spark computes partial aggregates before
the shuffle, so a key holding a third of the rows still sends one partial row
per map task, not its rows.  Marts are keyed by day or week, so the windows
run later on them see at most one row per day per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.calendar import day_of_week, iso_week, iso_year, week_start
from tillcast.functions.scalars import revenue, sum_or_zero


def overview(df: DataFrame) -> DataFrame:
    """Rows, distinct articles, distinct stores, first and last sale date."""
    return df.agg(
        F.count(F.lit(1)).alias("total_lignes"),
        F.count_distinct("CodeArticle").alias("nb_articles"),
        F.count_distinct("CodeMag").alias("nb_magasins"),
        F.min("Date").alias("premiere_vente"),
        F.max("Date").alias("derniere_vente"),
    )


def daily_mart(clean: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """The store-day mart by Date, CodeMag, Famille, Pays.

    With ``stores`` (CodeMag -> Pays) the fact is aggregated by Date,
    CodeMag, Famille first and the country is attached to the aggregate: the
    store join then touches one row per store, day and family instead of
    every sale line.  (A store is in one country, so the groups are the same.)
    """
    measures = [F.sum("Quantite").alias("sum_Quantite"), F.sum("Total").alias("sum_Total"),
                F.count(F.lit(1)).alias("nb_lignes")]
    if stores is None:
        return clean.groupBy("Date", "CodeMag", "Famille", "Pays").agg(*measures)
    agg = clean.groupBy("Date", "CodeMag", "Famille").agg(*measures)
    return attach_country(agg, stores)


def attach_country(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Add Pays from the store dimension (left join, as the fact view: a store without one keeps its rows)."""
    return (df.join(stores, on="CodeMag", how="left")
            .select("Date", "CodeMag", "Famille", "Pays", *[c for c in df.columns
                                                           if c not in ("Date", "CodeMag", "Famille")]))


def store_day_colours(clean: DataFrame) -> DataFrame:
    """Sales per (Date, CodeMag, Famille, ArCouleur, ArFamille): the one
    aggregate both the daily mart and the dominant colour are derived from,
    so the fact is scanned and shuffled once for both."""
    return clean.groupBy("Date", "CodeMag", "Famille", "ArCouleur", "ArFamille").agg(
        F.sum("Quantite").alias("sum_Quantite"), F.sum("Total").alias("sum_Total"),
        F.count(F.lit(1)).alias("nb_lignes"))


def country_daily_mart(clean: DataFrame, country: str, stores: DataFrame | None = None) -> DataFrame:
    """The one-country day mart by Date, Famille, with the
    number of distinct stores that sold (``nb_magasins``).

    With ``stores`` (CodeMag -> Pays) the fact needs no country: it is
    aggregated by Date, Famille, CodeMag first, and only one row per store, day
    and family meets the stores of the country."""
    if stores is not None:
        of_country = stores.filter(F.col("Pays") == country).select("CodeMag")
        by_store = clean.groupBy("Date", "Famille", "CodeMag").agg(
            F.sum("Quantite").alias("sum_Quantite"), F.sum("Total").alias("sum_Total"))
        return (by_store.join(of_country, "CodeMag", "left_semi").groupBy("Date", "Famille").agg(
            F.sum("sum_Quantite").alias("sum_Quantite"), F.sum("sum_Total").alias("sum_Total"),
            F.count("CodeMag").alias("nb_magasins")))
    return (clean.filter(F.col("Pays") == country)
            .groupBy("Date", "Famille").agg(
                F.sum("Quantite").alias("sum_Quantite"),
                F.sum("Total").alias("sum_Total"),
                F.count_distinct("CodeMag").alias("nb_magasins")))


def weekly_mart(clean: DataFrame, country: str | None = None) -> DataFrame:
    """The weekly mart by Famille and ISO week.

    Rows are grouped on the week's Monday; ``year`` is the ISO year and
    ``week_of_year`` the ISO week of that Monday, so 2022-01-01 falls in
    2021-W52.  Null dates are left out (they have no week).
    """
    src = clean if country is None else clean.filter(F.col("Pays") == country)
    weekly = (src.filter(F.col("Date").isNotNull())
              .groupBy("Famille", week_start("Date").alias("week_start"))
              .agg(F.sum("Quantite").alias("sum_Quantite")))
    return weekly.select(
        "Famille",
        iso_year("week_start").cast("int").alias("year"),
        iso_week("week_start").alias("week_of_year"),
        "week_start", "sum_Quantite")


def daily_series(df: DataFrame, value: str = "Quantite") -> DataFrame:
    """Total per day; null days dropped (N1), all-null sums are 0."""
    return (df.filter(F.col("Date").isNotNull())
            .groupBy("Date").agg(sum_or_zero(value).alias(value)))


def monthly_totals(df: DataFrame, value: str = "Quantite") -> DataFrame:
    """Total per month of year (1-12)."""
    return (df.filter(F.col("Date").isNotNull())
            .groupBy(F.month("Date").alias("Mois")).agg(sum_or_zero(value).alias(value)))


def weekday_totals(df: DataFrame, value: str = "Quantite") -> DataFrame:
    """Total per weekday, Monday = 0."""
    return (df.filter(F.col("Date").isNotNull())
            .groupBy(day_of_week("Date").alias("JourSemaine")).agg(sum_or_zero(value).alias(value)))


def family_target_stats(df: DataFrame, target: str = "sum_Quantite") -> DataFrame:
    """Per-family mean and sum of the target (null families dropped, N1)."""
    return (df.filter(F.col("Famille").isNotNull()).groupBy("Famille")
            .agg(F.avg(target).alias("mean_target"), F.sum(target).alias("sum_target")))


def distinct_counts(df: DataFrame, cols: tuple[str, ...] = ("CodeMag", "Famille", "Pays")) -> DataFrame:
    """Exact distinct count of each column (nulls not counted)."""
    return df.agg(*[F.count_distinct(c).alias(f"nb_{c}") for c in cols])


def top_groups(df: DataFrame, key: str, order_by: str, n: int = 10,
               prix: str = "Prix", quantite: str = "Quantite") -> DataFrame:
    """K2: the ``n`` groups with the largest ``order_by`` sum, reporting summed
    Quantite and Revenu (= Prix * Quantite).  Ties are broken by the key."""
    agg = (df.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(sum_or_zero(quantite).alias("Quantite"),
                sum_or_zero(revenue(prix, quantite)).alias("Revenu")))
    return agg.orderBy(F.desc(order_by), F.asc(key)).limit(n)


def top_days(series: DataFrame, value: str = "Quantite", n: int = 10) -> DataFrame:
    """K6: the ``n`` days with the highest total (ties by date)."""
    return series.orderBy(F.desc(value), F.asc("Date")).limit(n)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std (N10: pandas ``describe``), min, exact
    25/50/75 % (linear interpolation), max; one row per column.

    For a frame keyed by day (a daily series) the exact ``percentile``
    aggregate is bounded by the number of days.  For raw fact columns use
    :func:`tillcast.operators.outliers.exact_quantiles`, which never holds more
    than a fixed number of values in one task.
    """
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), q.alias(f"q{i}"), F.max(x).alias(f"hi{i}")]
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
            F.col(f"q{i}")[0].alias("p25"), F.col(f"q{i}")[1].alias("p50"),
            F.col(f"q{i}")[2].alias("p75"), F.col(f"hi{i}").alias("max")))
    # one scan for all columns, then one output row per column
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def describe_exact(df: DataFrame, cols: list[str]) -> DataFrame:
    """G21 for columns of any size, in two scans: the moments ride along with
    the sketches of :func:`tillcast.operators.outliers.quantiles_and_aggregates`
    (no task or driver result larger than a fixed bound).  Returns one row per column."""
    from tillcast.operators.outliers import quantiles_and_aggregates
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                 F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
    quart, mom = quantiles_and_aggregates(df, {c: [0.25, 0.5, 0.75] for c in cols}, aggs)
    rows = [(c, mom[f"n_{c}"], mom[f"m_{c}"], mom[f"s_{c}"], mom[f"lo_{c}"], *quart[c], mom[f"hi_{c}"])
            for c in cols]
    schema = ("variable string, count bigint, mean double, std double, min double, p25 double, "
              "p50 double, p75 double, max double")
    return df.sparkSession.createDataFrame(rows, schema)
