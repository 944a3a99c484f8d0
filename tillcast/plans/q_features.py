"""Mart, calendar, code and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.constants import STORE_LAGS
from tillcast.functions.calendar import add_daily_calendar
from tillcast.operators import features as FE
from tillcast.operators import marts as M
from tillcast.operators.encode import encode_many
from tillcast.plans import params as P
from tillcast.plans.catalog import WITH_CLEAN, clean_frame, register, rounded
from tillcast.sources.tables import store_country
from tillcast.session import materialize

MART_COLS = ["Date", "CodeMag", "Famille", "Quantite", "Total"]
CDAY_COLS = ["Date", "CodeMag", "Famille", "Quantite", "Total"]
WEEK_COLS = ["Date", "Famille", "Quantite"]
# The weekly mart covers every store: the threshold and family means of the
# fixtures (FIXTURES.md section 2) are those of the all-country weekly mart.
WEEKLY_COUNTRY = None


def _sq(names):
    """SQL list of names in a list literal."""
    return ", ".join(f"'{n}'" for n in names)


# ------------------------------------------------------------------ SQL building blocks

MART_SQL = f"""{WITH_CLEAN}, mart as (
  select Date, CodeMag, Famille, Pays, sum(Quantite) as sum_Quantite, sum(Total) as sum_Total,
         count(*) as nb_lignes
  from clean group by Date, CodeMag, Famille, Pays)"""

CAL_SQL = """cast(year(Date) as integer) as year, cast(month(Date) as integer) as month,
  cast(day(Date) as integer) as day, cast(isodow(Date) - 1 as integer) as day_of_week,
  cast(week(Date) as integer) as week_of_year, cast(quarter(Date) as integer) as quarter,
  cast(isodow(Date) >= 6 as integer) as is_weekend, cast(day(Date) = 1 as integer) as is_month_start,
  cast(Date = last_day(Date) as integer) as is_month_end"""

CDAY_SQL = f"""{WITH_CLEAN}, cday as (
  select Date, Famille, sum(Quantite) as sum_Quantite, sum(Total) as sum_Total,
         count(distinct CodeMag) as nb_magasins
  from clean where Pays = '{P.COUNTRY}' group by Date, Famille),
vday as (select * from cday where Famille is not null and not starts_with(Famille, '~')
         and regexp_full_match(Famille, '^[A-Za-zÀ-ÿ/\\s]+$')),
bounds as (select min(Date) as lo, max(Date) as hi from vday),
grid as (select f.Famille, cast(unnest(generate_series(b.lo, b.hi, interval 1 day)) as date) as Date
         from (select distinct Famille from vday) f, bounds b),
filled as (select g.Date, g.Famille, coalesce(v.sum_Quantite, 0) as sum_Quantite,
                  coalesce(v.sum_Total, 0) as sum_Total, cast(coalesce(v.nb_magasins, 0) as double) as nb_magasins
           from grid g left join vday v on g.Famille = v.Famille and g.Date = v.Date)"""

WEEKLY_SQL = f"""{WITH_CLEAN}, wk as (
  select Famille, cast(date_trunc('week', Date) as date) as week_start, sum(Quantite) as sum_Quantite
  from clean where Date is not null group by 1, 2),
weekly as (select Famille, cast(isoyear(week_start) as integer) as year,
                  cast(week(week_start) as integer) as week_of_year, week_start, sum_Quantite from wk)"""


def _lag_sql(value, keys, order, lags, rolling, full):
    w = f"partition by {keys} order by {order}"
    parts = [f"lag({value}, {k}) over ({w}) as lag_{k}" for k in lags]
    for k in rolling:
        frame = f"({w} rows between {k} preceding and 1 preceding)"
        mean = f"avg({value}) over {frame}"
        parts.append(f"case when count({value}) over {frame} = {k} then {mean} end as rolling_mean_{k}"
                     if full else f"{mean} as rolling_mean_{k}")
    return ",\n  ".join(parts)


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


STORE_FEAT_SQL = f"""{MART_SQL},
feat as (
  select Date, CodeMag, Famille, Pays, sum_Quantite, sum_Total, nb_lignes, {CAL_SQL},
  cast(dense_rank() over (order by Pays) - 1 as integer) as Pays_encoded,
  cast(dense_rank() over (order by Famille) - 1 as integer) as Famille_encoded,
  cast(dense_rank() over (order by CodeMag) - 1 as integer) as CodeMag_encoded,
  {_lag_sql('sum_Quantite', 'CodeMag, Famille', 'Date', STORE_LAGS, [7, 30], False)}
  from mart),
dom as (
  select Date, CodeMag, Famille, ArCouleur as dominant_couleur, ArFamille as dominant_sfamille from (
    select Date, CodeMag, Famille, ArCouleur, ArFamille, count(*) as nb,
           row_number() over (partition by Date, CodeMag, Famille
                              order by count(*) desc, ArCouleur, ArFamille) as rn
    from clean where ArCouleur is not null and ArCouleur != ''
    group by Date, CodeMag, Famille, ArCouleur, ArFamille) r
  where rn = 1)"""

STORE_OUT = ("Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite, "
             "round(sum_Total, 6) as sum_Total, nb_lignes, year, month, day, day_of_week, week_of_year, "
             "quarter, is_weekend, is_month_start, is_month_end, Pays_encoded, Famille_encoded, "
             "CodeMag_encoded, " + _r(["lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_mean_30"]))


# ------------------------------------------------------------------ marts

@register("mart_daily", f"""{MART_SQL}
select Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite,
       round(sum_Total, 6) as sum_Total, nb_lignes from mart""")
def q_mart_daily(spark, d):
    return rounded(M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d)))


@register("mart_country_daily", f"""{CDAY_SQL}
select Date, Famille, round(sum_Quantite, 6) as sum_Quantite, round(sum_Total, 6) as sum_Total,
       nb_magasins from cday""")
def q_mart_country_daily(spark, d):
    return rounded(M.country_daily_mart(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, store_country(spark, d)))


@register("mart_weekly", f"""{WEEKLY_SQL}
select Famille, year, week_of_year, week_start, round(sum_Quantite, 6) as sum_Quantite from weekly""")
def q_mart_weekly(spark, d):
    return rounded(M.weekly_mart(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY))


# ------------------------------------------------------------------ calendar, codes, families

@register("calendar_features", f"""{MART_SQL}
select Date, CodeMag, Famille, {CAL_SQL} from mart""")
def q_calendar_features(spark, d):
    mart = M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d))
    return add_daily_calendar(mart).drop("Pays", "sum_Quantite", "sum_Total", "nb_lignes")


@register("encode_codes", f"""{MART_SQL}
select Date, CodeMag, Famille, Pays,
       cast(dense_rank() over (order by Pays) - 1 as integer) as Pays_encoded,
       cast(dense_rank() over (order by Famille) - 1 as integer) as Famille_encoded,
       cast(dense_rank() over (order by CodeMag) - 1 as integer) as CodeMag_encoded
from mart""")
def q_encode_codes(spark, d):
    mart = materialize(M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d)))
    return encode_many(mart.select("Date", "CodeMag", "Famille", "Pays"), ["Pays", "Famille", "CodeMag"])


@register("valid_families", f"""{CDAY_SQL}
select Date, Famille, round(sum_Quantite, 6) as sum_Quantite, round(sum_Total, 6) as sum_Total,
       nb_magasins from vday""")
def q_valid_families(spark, d):
    mart = M.country_daily_mart(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, store_country(spark, d))
    return rounded(FE.valid_families(mart))


@register("calendar_fill", f"""{CDAY_SQL}
select Date, Famille, round(sum_Quantite, 6) as sum_Quantite, round(sum_Total, 6) as sum_Total,
       nb_magasins from filled""")
def q_calendar_fill(spark, d):
    mart = materialize(FE.valid_families(M.country_daily_mart(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, store_country(spark, d))))
    return rounded(FE.calendar_fill(mart))


# ------------------------------------------------------------------ feature tables

@register("lag_features_store", f"""{STORE_FEAT_SQL}
select {STORE_OUT} from feat
where lag_7 is not null and lag_14 is not null and lag_28 is not null""")
def q_lag_features_store(spark, d):
    return rounded(FE.store_features(clean_frame(spark, d, MART_COLS), with_dominant=False,
                                     stores=store_country(spark, d)))


@register("features_joined", f"""{STORE_FEAT_SQL}
select {STORE_OUT}, dom.dominant_couleur, dom.dominant_sfamille
from feat left join dom using (Date, CodeMag, Famille)
where lag_7 is not null and lag_14 is not null and lag_28 is not null""")
def q_features_joined(spark, d):
    cols = MART_COLS + ["ArCouleur", "ArFamille"]
    return rounded(FE.store_features(clean_frame(spark, d, cols), with_dominant=True,
                                     stores=store_country(spark, d)))


@register("dominant_colour", f"""{STORE_FEAT_SQL}
select * from dom""")
def q_dominant_colour(spark, d):
    return FE.dominant_attribute(clean_frame(spark, d, ["Date", "CodeMag", "Famille", "ArCouleur", "ArFamille"]))


@register("lag_features_daily", f"""{CDAY_SQL}, feat as (
  select Date, Famille, sum_Quantite, sum_Total, nb_magasins, {CAL_SQL},
  cast(dense_rank() over (order by Famille) - 1 as integer) as Famille_encoded,
  {_lag_sql('sum_Quantite', 'Famille', 'Date', STORE_LAGS, [7, 30], True)}
  from filled)
select Date, Famille, {_r(['sum_Quantite', 'sum_Total', 'nb_magasins'])}, year, month, day, day_of_week,
       week_of_year, quarter, is_weekend, is_month_start, is_month_end, Famille_encoded,
       {_r(['lag_7', 'lag_14', 'lag_28', 'rolling_mean_7', 'rolling_mean_30'])}
from feat where lag_7 is not null and lag_14 is not null and lag_28 is not null
  and rolling_mean_7 is not null and rolling_mean_30 is not null""")
def q_lag_features_daily(spark, d):
    return rounded(FE.country_daily_features(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, stores=store_country(spark, d)))


@register("lag_features_by_day", f"""{CDAY_SQL}, feat as (
  select Date, Famille, sum_Quantite, {_lag_sql('sum_Quantite', 'Famille', 'Date', STORE_LAGS, [7, 30], True)}
  from filled)
select f.Date, f.Famille, {_r(['f.sum_Quantite', 'lag_7', 'lag_14', 'lag_28', 'rolling_mean_7', 'rolling_mean_30'])
                           .replace('as f.', 'as ')}
from feat f join vday v on f.Famille = v.Famille and f.Date = v.Date""")
def q_lag_features_by_day(spark, d):
    """W1 + W3 by date (fill 'D'): the days that have sales, with the lags and
    means that the filled calendar gives; the oracle fills, then lags by row."""
    mart = materialize(FE.valid_families(M.country_daily_mart(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, store_country(spark, d))))
    first = F.broadcast(mart.agg(F.min("Date").alias("first_day")))
    df = FE.add_date_lags(mart.join(first), ["Famille"], "Date", STORE_LAGS, [7, 30], full_windows=True,
                          unit="D", fill=0.0, start="first_day")
    return rounded(df.drop("first_day", "sum_Total", "nb_magasins"))


@register("lag_features_by_week", f"""{WEEKLY_SQL},
spans as (select Famille, min(week_start) as lo, max(week_start) as hi from weekly where Famille is not null group by Famille),
wgrid as (select Famille, cast(unnest(generate_series(lo, hi, interval 7 day)) as date) as week_start from spans),
wfill as (select g.Famille, g.week_start, coalesce(w.sum_Quantite, 0) as filled, w.sum_Quantite
          from wgrid g left join weekly w on g.Famille = w.Famille and g.week_start = w.week_start),
feat as (select *, {_lag_sql('sum_Quantite', 'Famille', 'week_start', [1, 2, 4, 52], [], True)},
  {_lag_sql('filled', 'Famille', 'week_start', [], [4, 12], False)} from wfill)
select Famille, week_start, {_r(['sum_Quantite', 'lag_1', 'lag_2', 'lag_4', 'lag_52', 'rolling_mean_4', 'rolling_mean_12'])}
from feat where sum_Quantite is not null""")
def q_lag_features_by_week(spark, d):
    """W1 by date in ISO weeks: lags of weeks without sales are null (no fill);
    the means count such weeks as 0 (fill 'W' from the family's first week)."""
    mart = materialize(M.weekly_mart(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY).filter(F.col("Famille").isNotNull()))
    df = FE.add_date_lags(mart, ["Famille"], "week_start", [1, 2, 4, 52], [], True, unit="W")
    df = FE.add_date_lags(df, ["Famille"], "week_start", [], [4, 12], False, unit="W", fill=0.0)
    return rounded(df.drop("year", "week_of_year"))


WEEKLY_CAL_SQL = """cast(month(week_start) as integer) as month, cast(quarter(week_start) as integer) as quarter,
  cast(month(week_start) in (6, 7, 8) as integer) as is_summer,
  cast(month(week_start) in (12, 1, 2) as integer) as is_winter,
  cast(month(week_start) in (1, 7) as integer) as is_soldes"""


WEEKLY_V1_SQL = f"""{WEEKLY_SQL}, feat as (
  select Famille, year, week_of_year, week_start, sum_Quantite, {WEEKLY_CAL_SQL},
  cast(dense_rank() over (order by Famille) - 1 as integer) as Famille_encoded,
  {_lag_sql('sum_Quantite', 'Famille', 'year, week_of_year', [1, 2, 4], [4, 12], True)}
  from weekly),
v1 as (select * from feat where Famille is not null and lag_1 is not null and lag_2 is not null and lag_4 is not null
  and rolling_mean_4 is not null and rolling_mean_12 is not null)"""


@register("weekly_features_v1", f"""{WEEKLY_V1_SQL}
select Famille, year, week_of_year, week_start, round(sum_Quantite, 6) as sum_Quantite, month, quarter,
       is_summer, is_winter, is_soldes, Famille_encoded,
       {_r(['lag_1', 'lag_2', 'lag_4', 'rolling_mean_4', 'rolling_mean_12'])}
from v1""")
def q_weekly_features_v1(spark, d):
    return rounded(FE.weekly_features_v1(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY))


WEEKLY_V2_SQL = f"""{WEEKLY_SQL}, feat as (
  select Famille, year, week_of_year, week_start, sum_Quantite, {WEEKLY_CAL_SQL},
  cast((Famille in ({_sq(P.SUMMER_FAMILIES)}) and month(week_start) in (6, 7, 8))
       or (Famille in ({_sq(P.WINTER_FAMILIES)}) and month(week_start) in (12, 1, 2)) as integer)
       as is_high_season,
  cast(dense_rank() over (order by Famille) - 1 as integer) as Famille_encoded,
  {_lag_sql('sum_Quantite', 'Famille', 'year, week_of_year', [1, 2, 4, 52], [4, 12], True)}
  from weekly),
v2 as (
  select Famille, year, week_of_year, week_start, sum_Quantite, month, quarter, is_summer, is_winter,
         is_soldes, is_high_season, Famille_encoded, lag_1, lag_2, lag_4,
         coalesce(lag_52, rolling_mean_12) as lag_52, rolling_mean_4, rolling_mean_12
  from feat where lag_1 is not null and lag_2 is not null and lag_4 is not null
    and rolling_mean_4 is not null and rolling_mean_12 is not null)"""

V2_OUT = ("Famille, year, week_of_year, week_start, round(sum_Quantite, 6) as sum_Quantite, month, quarter, "
          "is_summer, is_winter, is_soldes, is_high_season, Famille_encoded, "
          + _r(["lag_1", "lag_2", "lag_4", "lag_52", "rolling_mean_4", "rolling_mean_12"]))


def weekly_v2(spark, d):
    return FE.weekly_features_v2(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY,
                                 P.SUMMER_FAMILIES, P.WINTER_FAMILIES)


register("weekly_features_v2", f"""{WEEKLY_V2_SQL}
select {V2_OUT} from v2""")(lambda spark, d: rounded(weekly_v2(spark, d)))


# ------------------------------------------------------------------ summaries of the store mart

@register("distinct_counts", f"""{MART_SQL}
select count(distinct CodeMag) as nb_CodeMag, count(distinct Famille) as nb_Famille,
       count(distinct Pays) as nb_Pays from mart""")
def q_distinct_counts(spark, d):
    """Stores, families and countries of the daily mart."""
    return M.distinct_counts(M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d)))


@register("feature_summary", f"""{STORE_FEAT_SQL}
select count(*) as row_count, min(Date) as date_min, max(Date) as date_max,
       'Date, CodeMag, Famille, Pays, sum_Quantite, sum_Total, nb_lignes' as "columns"
from mart""")
def q_feature_summary(spark, d):
    """Row count, date range and column list of the daily mart."""
    from tillcast.sources.sinks import feature_summary
    mart = M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d))
    return feature_summary(mart, "Date").select("row_count", "date_min", "date_max",
                                                F.array_join("columns", ", ").alias("columns"))


@register("family_means", f"""{WEEKLY_V2_SQL}
select Famille, round(avg(sum_Quantite), 6) as mean_target, round(sum(sum_Quantite), 6) as sum_target
from v2 where Famille is not null group by Famille""")
def q_family_means(spark, d):
    """Per-family mean and sum of the weekly target."""
    return rounded(M.family_target_stats(weekly_v2(spark, d)))


@register("feature_value_counts", f"""{MART_SQL},
counted as (select 'Famille' as "column", Famille as value, count(*) as "count" from mart group by Famille
            union all select 'Pays', Pays, count(*) from mart group by Pays)
select * from counted where value is not null
qualify "column" = 'Pays' or row_number() over (partition by "column" order by "count" desc, value) <= 10""")
def q_feature_value_counts(spark, d):
    """The ten most frequent families and all country counts of the daily mart."""
    from tillcast.sources.sinks import feature_counts
    mart = M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d))
    return feature_counts(mart, {"Famille": 10, "Pays": None})


# fixed values: Spark's type names of the lineitem columns, in order
LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@register("schema_lookup", " union all ".join(
    f"""select '{c}' as COLUMN_NAME, '{t}' as DATA_TYPE, 'YES' as IS_NULLABLE,
       '{'PRI' if c == 'l_orderkey' else ''}' as COLUMN_KEY, {i + 1} as ORDINAL_POSITION,
       count(*) as ROW_COUNT, count(*) - count({c}) as NULL_COUNT from lineitem"""
    for i, (c, t) in enumerate(LINEITEM_TYPES.items())))
def q_schema_lookup(spark, d):
    """Name, type, nullability, key flag and position of lineitem's columns, with their row and null counts."""
    from tillcast.sources.sinks import schema_counts
    from tillcast.sources.tables import read_table
    return schema_counts(read_table(spark, d, "lineitem"), "l_orderkey")


@register("mart_daily_by_year", f"""{MART_SQL}
select Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite,
       round(sum_Total, 6) as sum_Total, nb_lignes, cast(year(Date) as integer) as year
from mart""")
def q_mart_daily_by_year(spark, d):
    """S4 + the mart layout of SURVEY 4: the daily mart written as Parquet
    partitioned by year and sorted by (Famille, Date) inside files, in the
    checkpoint folder and read back whole."""
    import uuid

    from pyspark.sql import functions as F

    from tillcast.session import checkpoint_dir
    from tillcast.sources.sinks import replace_table
    path = f"{checkpoint_dir(spark).rstrip('/')}/mart-daily-{uuid.uuid4().hex}"
    mart = M.daily_mart(clean_frame(spark, d, MART_COLS), store_country(spark, d))
    replace_table(mart.withColumn("year", F.year("Date")), path, partition_by=["year"],
                  sort_within=["Famille", "Date"])
    return rounded(spark.read.parquet(path))


@register("table_check", """select 'sales_lines' as "table", true as "exists", count(*) as row_count from lineitem""")
def q_table_check(spark, d):
    """A catalog view over the fact lines exists and its row count."""
    from tillcast.sources.sinks import table_check
    from tillcast.sources.tables import read_table
    read_table(spark, d, "lineitem").createOrReplaceTempView("sales_lines")
    return table_check(spark, "sales_lines")
