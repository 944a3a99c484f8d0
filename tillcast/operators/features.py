"""Time-series features (W1-W3, W6, G24, J1, J4, P8, P12, P13) and the four
feature tables of the reference (store daily, country daily, weekly v1, v2).

Lags are by row, not by date: ``lag_7`` is "7 rows earlier in the series".
Only the country daily table is gap-filled first (J4), so there a row is a day.
All lags and rolling means of one table share one window partitioning, so
the plan has one exchange, one sort and one Window node for all of them.  The
windows run on marts (one row per series per day or week), so a partition
holds at most the number of days in the data, whatever the fact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import (STORE_LAGS, STORE_ROLLING, TARGET, WEEKLY_LAGS_V1,
                                WEEKLY_LAGS_V2, WEEKLY_ROLLING)
from tillcast.functions.calendar import add_daily_calendar, add_weekly_calendar
from tillcast.functions.scalars import valid_family
from tillcast.operators.encode import encode, encode_many
from tillcast.operators.marts import (attach_country, country_daily_mart, daily_mart,
                                     store_day_colours, weekly_mart)
from tillcast.session import materialize as checkpointed


def series_window(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def lag_columns(value: str, w: Window, lags: list[int]) -> dict[str, Column]:
    """``lag_k`` = value k rows earlier in the series."""
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def rolling_mean_columns(value: str, w: Window, sizes: list[int], full: bool) -> dict[str, Column]:
    """Trailing means of the ``k`` rows before the current one.

    W2 (``full=False``): partial windows allowed, at least one non-null value.
    W3 (``full=True``): null unless all ``k`` rows exist and are non-null
    (pandas ``rolling(k)`` on the shifted series).
    """
    out = {}
    for k in sizes:
        frame = w.rowsBetween(-k, -1)
        mean = F.avg(value).over(frame)
        out[f"rolling_mean_{k}"] = F.when(F.count(value).over(frame) == k, mean) if full else mean
    return out


def add_lag_features(df: DataFrame, keys: list[str], order: list[str], lags: list[int],
                     rolling: list[int], full_windows: bool, value: str = TARGET) -> DataFrame:
    """W1 + W2/W3 in one window pass.  Null keys get no lags (pandas drops
    null group keys, N1)."""
    w = series_window(keys, order)
    cols = {**lag_columns(value, w, lags), **rolling_mean_columns(value, w, rolling, full_windows)}
    not_null_keys = F.lit(True)
    for k in keys:
        not_null_keys = not_null_keys & F.col(k).isNotNull()
    return df.withColumns({name: F.when(not_null_keys, c) for name, c in cols.items()})


def drop_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P12 (``subset``) / P13 (any column)."""
    return df.dropna(how="any", subset=subset)


def fill_long_lag(df: DataFrame, lag: str = "lag_52", fallback: str = "rolling_mean_12") -> DataFrame:
    """A missing long lag takes the fallback column."""
    return df.withColumn(lag, F.coalesce(F.col(lag), F.col(fallback)))


def valid_families(df: DataFrame, col: str = "Famille") -> DataFrame:
    """P8."""
    return df.filter(valid_family(col))


def calendar_fill(df: DataFrame, key: str = "Famille", date_col: str = "Date",
                  measures: tuple[str, ...] = ("sum_Quantite", "sum_Total", "nb_magasins")) -> DataFrame:
    """Every day from the global first to the global last day, for every
    key; the measures get 0 where missing (and the counts become doubles, as
    after a pandas fill).

    Each row emits its own day and the missing days up to the key's next row
    (``lead``); a key's first row also emits the days before it.  Nothing is
    joined but the one-row bounds, and no grid of keys and days is made.  The
    input is read twice, so give a materialized mart with one row per
    (key, day).  Rows without a key or a day are left out; an empty input gives
    no rows.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(date_col).isNotNull()).select(
        F.col(key), F.col(date_col).alias("_day"), *[F.col(m).cast("double").alias(m) for m in measures])
    bounds = rows.agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"))       # one row
    w = Window.partitionBy(key).orderBy("_day")
    spans = rows.withColumns({"_prev": F.lag("_day").over(w), "_next": F.lead("_day").over(w)}).join(F.broadcast(bounds))
    first = F.when(F.col("_prev").isNull(), F.col("_lo")).otherwise(F.col("_day"))
    last = F.coalesce(F.date_sub("_next", 1), F.col("_hi"))
    days = spans.withColumn(date_col, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))))
    own = F.col(date_col) == F.col("_day")
    return days.select(date_col, key, *[F.when(own, F.coalesce(m, F.lit(0.0))).otherwise(0.0).alias(m) for m in measures])


def add_date_lags(df: DataFrame, keys: list[str], date_col: str, lags: list[int], rolling: list[int],
                  full_windows: bool, value: str = TARGET, unit: str = "D", fill: float | None = None,
                  start: str | None = None) -> DataFrame:
    """W1 + W2/W3 by date: ``lag_k`` is the value ``k`` days (``unit='D'``) or
    ISO weeks (``'W'``) earlier, whatever rows lie between.

    RANGE frames over the day or week number find the earlier rows, so no
    missing rows are made.  With ``fill`` a missing day counts as that value
    from ``start`` on (a column with the first day of the calendar; by default
    the key's own first day): the same numbers as lags by row over a filled
    calendar.  Without it a missing day has no value: its lag is null, means
    leave it out, and ``full_windows`` asks for all ``k`` values.  Input: one
    row per key and day (week); rows with a null key or date get nulls.
    """
    if unit not in ("D", "W"):
        raise ValueError("unit is 'D' or 'W'")
    monday = F.lit("1970-01-05").cast("date")

    def number(c: Column) -> Column:
        days = F.datediff(c, monday)
        return days if unit == "D" else F.floor(days / 7).cast("int")

    own = [c for c in df.columns]
    known = F.col(date_col).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    at = df.withColumn("_at", number(F.col(date_col)))
    series = Window.partitionBy(*keys)
    begin = number(F.col(start)) if start else F.min("_at").over(series)
    at = at.withColumn("_from", begin)
    order = series.orderBy("_at")
    past = F.col("_at") - F.col("_from")            # days of the calendar before this one
    out = {}
    for k in lags:
        found = F.max(value).over(order.rangeBetween(-k, -k))
        out[f"lag_{k}"] = found if fill is None else F.when(past >= k, F.coalesce(found, F.lit(float(fill))))
    for k in rolling:
        frame = order.rangeBetween(-k, -1)
        n, total = F.count(value).over(frame), F.sum(value).over(frame)
        if fill is None:
            mean = F.try_divide(total, n)
            out[f"rolling_mean_{k}"] = F.when(n == k, mean) if full_windows else mean
        else:
            size = F.least(past, F.lit(k))
            mean = F.try_divide(F.coalesce(total, F.lit(0.0)) + (size - n) * float(fill), size)
            out[f"rolling_mean_{k}"] = F.when(past >= k, mean) if full_windows else mean
    return at.withColumns({name: F.when(known, c) for name, c in out.items()}).select(*own, *out)


def dominant_attribute(clean: DataFrame, keys: tuple[str, ...] = ("Date", "CodeMag", "Famille"),
                       attr: str = "ArCouleur", second: str = "ArFamille") -> DataFrame:
    """G24 + W4: per (Date, CodeMag, Famille), the most frequent
    (ArCouleur, ArFamille) pair among rows with a non-empty colour.

    Ties go to the smallest colour, then the smallest sub-family.  Written as
    one aggregate: count per pair, then ``min(struct(-count, colour, sub))``
    per key, which Spark computes partially before the shuffle (no window sort
    over a key's rows).
    """
    pairs = clean.groupBy(*keys, attr, second).agg(F.count(F.lit(1)).alias("nb_lignes"))
    return dominant_from_counts(pairs, keys, attr, second)


def dominant_from_counts(pairs: DataFrame, keys: tuple[str, ...] = ("Date", "CodeMag", "Famille"),
                         attr: str = "ArCouleur", second: str = "ArFamille", count: str = "nb_lignes") -> DataFrame:
    """G24 from per-pair row counts (one row per key and pair); the winning
    pair is renamed (P2) to ``dominant_couleur`` / ``dominant_sfamille``."""
    pairs = (pairs.filter(F.col(attr).isNotNull() & (F.col(attr) != ""))
             .select(*keys, attr, second, F.col(count).alias("nb")))
    best = pairs.groupBy(*keys).agg(
        F.min(F.struct((-F.col("nb")).alias("neg_nb"), F.col(attr).alias("a"),
                       F.col(second).alias("b"))).alias("best"))
    return best.select(*keys, F.col("best.a").alias("dominant_couleur"),
                       F.col("best.b").alias("dominant_sfamille"))


def join_dominant(features: DataFrame, dominant: DataFrame,
                  keys: tuple[str, ...] = ("Date", "CodeMag", "Famille")) -> DataFrame:
    """Left join on three keys, null-safe (pandas merge matches null with null)."""
    d = dominant.select(*[F.col(k).alias(f"_d_{k}") for k in keys], "dominant_couleur", "dominant_sfamille")
    cond = [features[k].eqNullSafe(d[f"_d_{k}"]) for k in keys]
    return features.join(d, on=cond, how="left").drop(*[f"_d_{k}" for k in keys])


# ---------------------------------------------------------------- feature tables

def store_features(clean: DataFrame, with_dominant: bool = True, stores: DataFrame | None = None,
                   materialize: bool = True) -> DataFrame:
    """Daily store x family features: G5 mart, X1-X5, X10 codes, W1 lags
    7/14/28 by (CodeMag, Famille), W2 means 7/30, J1 dominant colour, P12.

    With ``stores`` (CodeMag -> Pays) the country is attached after the
    aggregation.  With the dominant colour, the fact is aggregated once by
    (Date, CodeMag, Famille, colour, sub-family) and both the mart and the
    dominant colour are derived from that aggregate.  ``materialize`` writes
    the aggregate to the checkpoint folder: the code tables, the windows and
    the join then read it instead of recomputing the fact scan, and lineage
    stops there if an executor is lost.
    """
    dominant = None
    if with_dominant and stores is not None:
        fine = store_day_colours(clean)
        if materialize:
            fine = checkpointed(fine)
        # the mart and the dominant colour are both aggregated on
        # (Date, CodeMag, Famille), so they arrive hash-partitioned alike and
        # join without another exchange.  A plain equi-join: rows with a null
        # key get no lags and are dropped below, so null-safe matching
        # would not change the output.
        keys = ["Date", "CodeMag", "Famille"]
        agg = fine.groupBy(*keys).agg(
            F.sum("sum_Quantite").alias("sum_Quantite"), F.sum("sum_Total").alias("sum_Total"),
            F.sum("nb_lignes").alias("nb_lignes"))
        mart = attach_country(agg.join(dominant_from_counts(fine), keys, "left"), stores)
    else:
        mart = daily_mart(clean, stores)
        if with_dominant:
            dominant = dominant_attribute(clean)
    if materialize:
        mart = checkpointed(mart)
    df = add_daily_calendar(mart)
    df = encode_many(df, ["Pays", "Famille", "CodeMag"])
    df = add_lag_features(df, ["CodeMag", "Famille"], ["Date"], STORE_LAGS, STORE_ROLLING,
                          full_windows=False)
    if dominant is not None:
        df = join_dominant(df, dominant)
    return drop_null(df, [f"lag_{k}" for k in STORE_LAGS])


def country_daily_features(clean: DataFrame, country: str, materialize: bool = True,
                           stores: DataFrame | None = None) -> DataFrame:
    """Daily family features for one country: G6 mart, P8, J4 day fill,
    X1-X5, X10, W1 lags 7/14/28 by Famille, W3 means 7/30, P12.  The mart
    is materialized once (the fill reads its bounds and its rows)."""
    mart = valid_families(country_daily_mart(clean, country, stores))
    if materialize:
        mart = checkpointed(mart)
    df = calendar_fill(mart)
    df = add_daily_calendar(df)
    df = encode(df, "Famille")
    df = add_lag_features(df, ["Famille"], ["Date"], STORE_LAGS, STORE_ROLLING, full_windows=True)
    return drop_null(df, [f"lag_{k}" for k in STORE_LAGS] + [f"rolling_mean_{k}" for k in STORE_ROLLING])


def weekly_features_v1(clean: DataFrame, country: str | None, materialize: bool = True) -> DataFrame:
    """Weekly family features v1: G7 mart, month/quarter/X6, X10, lags 1/2/4,
    W3 means 4/12, then P13 (a null in any column drops the row)."""
    mart = weekly_mart(clean, country)
    if materialize:
        mart = checkpointed(mart)       # read by the code table and the windows
    df = add_weekly_calendar(mart, with_high_season=False)
    df = encode(df, "Famille")
    df = add_lag_features(df, ["Famille"], ["year", "week_of_year"], WEEKLY_LAGS_V1, WEEKLY_ROLLING,
                          full_windows=True)
    return drop_null(df)


def weekly_features_v2(clean: DataFrame, country: str | None,
                       summer_families: list[str] | None = None,
                       winter_families: list[str] | None = None, materialize: bool = True) -> DataFrame:
    """Weekly family features v2: v1 plus X7 ``is_high_season`` and ``lag_52``;
    P12 on the core columns, then W6 fills ``lag_52`` from ``rolling_mean_12``."""
    mart = weekly_mart(clean, country)
    if materialize:
        mart = checkpointed(mart)       # read by the code table and the windows
    df = add_weekly_calendar(mart, with_high_season=True,
                             summer_families=summer_families, winter_families=winter_families)
    df = encode(df, "Famille")
    df = add_lag_features(df, ["Famille"], ["year", "week_of_year"], WEEKLY_LAGS_V2, WEEKLY_ROLLING,
                          full_windows=True)
    core = ["lag_1", "lag_2", "lag_4", "rolling_mean_4", "rolling_mean_12"]
    return fill_long_lag(drop_null(df, core))
