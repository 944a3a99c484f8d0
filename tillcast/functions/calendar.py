"""Calendar columns (X1-X8).  All are built-in expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.constants import (SOLDES_MONTHS, SUMMER_FAMILIES, SUMMER_MONTHS,
                                WINTER_FAMILIES, WINTER_MONTHS)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(d: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dt.dayofweek``)."""
    return F.weekday(_c(d))


def iso_week(d: str | Column) -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(_c(d))


def iso_year(d: str | Column) -> Column:
    """ISO year of a date (2022-01-01 belongs to 2021-W52)."""
    return F.extract(F.lit("YEAROFWEEK"), _c(d))


def week_start(d: str | Column) -> Column:
    """Monday of the ISO week holding ``d``."""
    return F.date_trunc("week", _c(d)).cast("date")


def is_weekend(d: str | Column) -> Column:
    """Saturday or Sunday, as 0/1."""
    return (day_of_week(d) >= 5).cast("int")


def is_month_start(d: str | Column) -> Column:
    """X5."""
    return (F.dayofmonth(_c(d)) == 1).cast("int")


def is_month_end(d: str | Column) -> Column:
    """X5."""
    return (_c(d) == F.last_day(_c(d))).cast("int")


def add_daily_calendar(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """X1-X5 on a daily frame: year, month, day, day_of_week, week_of_year,
    quarter, is_weekend, is_month_start, is_month_end."""
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": day_of_week(d),
        "week_of_year": iso_week(d),
        "quarter": F.quarter(d),
        "is_weekend": is_weekend(d),
        "is_month_start": is_month_start(d),
        "is_month_end": is_month_end(d),
    })


def season_flags(month: str | Column) -> dict[str, Column]:
    """is_summer, is_winter, is_soldes from the month."""
    m = _c(month)
    return {
        "is_summer": m.isin(SUMMER_MONTHS).cast("int"),
        "is_winter": m.isin(WINTER_MONTHS).cast("int"),
        "is_soldes": m.isin(SOLDES_MONTHS).cast("int"),
    }


def high_season(family: str | Column, is_summer: str | Column, is_winter: str | Column,
                summer_families: list[str] | None = None,
                winter_families: list[str] | None = None) -> Column:
    """A summer family in summer or a winter family in winter, as 0/1."""
    sf = SUMMER_FAMILIES if summer_families is None else summer_families
    wf = WINTER_FAMILIES if winter_families is None else winter_families
    fam = _c(family)
    return (F.when(fam.isin(sf) & (_c(is_summer) == 1), 1)
            .when(fam.isin(wf) & (_c(is_winter) == 1), 1)
            .otherwise(0))


def add_weekly_calendar(df: DataFrame, week_start_col: str = "week_start",
                        family_col: str = "Famille", with_high_season: bool = True,
                        summer_families: list[str] | None = None,
                        winter_families: list[str] | None = None) -> DataFrame:
    """month and quarter of the week's Monday, X6 flags and (v2) X7."""
    ws = F.col(week_start_col)
    out = df.withColumns({"month": F.month(ws), "quarter": F.quarter(ws)})
    out = out.withColumns(season_flags("month"))
    if with_high_season:
        out = out.withColumn("is_high_season", high_season(
            family_col, "is_summer", "is_winter", summer_families, winter_families))
    return out


def iso_week_monday(year: str | Column, week: str | Column) -> Column:
    """Monday of ISO ``year``-W``week``; null when the week does not exist.

    Week 1 is the week holding 4 January.  A week number past the last week of
    that ISO year (53 in a 52-week year) or below 1 gives null, so callers can
    reject the row instead of raising.
    """
    monday = F.date_add(
        F.date_trunc("week", F.make_date(_c(year), F.lit(1), F.lit(4))).cast("date"),
        (_c(week) - 1) * 7)
    valid = (_c(week) >= 1) & (iso_week(monday) == _c(week)) & (iso_year(monday) == _c(year))
    return F.when(valid, monday)
