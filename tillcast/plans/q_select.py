"""Selection and evaluation queries.

The evaluation is exercised with the naive seasonal model (M8), which SQL can
express, so every metric variant has an oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.constants import FLOAT_EPS
from tillcast.operators import evaluate as EV
from tillcast.operators import features as FE
from tillcast.operators import select as S
from tillcast.plans import params as P
from tillcast.plans.catalog import clean_frame, register, rounded
from tillcast.session import materialize
from tillcast.sources.tables import store_country
from tillcast.plans.q_features import MART_COLS, STORE_FEAT_SQL, WEEKLY_V2_SQL, _sq, weekly_v2

HV_SQL = f"""{WEEKLY_V2_SQL},
hv as (select * from v2 where Famille in (
         select Famille from v2 group by Famille having avg(sum_Quantite) >= {P.THRESHOLD})
       and (Famille not in ({_sq(P.EXCLUDE)}) or Famille is null)),
trainmean as (select avg(sum_Quantite) as m from hv where week_start < DATE '{P.TEST_CUT}'),
naive as (
  select week_start, Famille, sum_Quantite as y,
         case when coalesce(lag_52, (select m from trainmean)) < 0 then 0
              else coalesce(lag_52, (select m from trainmean)) end as p,
         case when coalesce(lag_52, t.tm) < 0 then 0 else coalesce(lag_52, t.tm) end as p_test_mean
  from hv, (select avg(sum_Quantite) as tm from hv where week_start >= DATE '{P.TEST_CUT}') t
  where week_start >= DATE '{P.TEST_CUT}')"""

STORE_SQL = f"""{STORE_FEAT_SQL},
sf as (select Date, CodeMag, Famille, Pays, sum_Quantite from feat
       where lag_7 is not null and lag_14 is not null and lag_28 is not null)"""


def _r2_sql(y: str, p: str) -> str:
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * count({y}))"
    return (f"case when count({y}) < 2 then cast('nan' as double) when {sst} = 0 then "
            f"case when {sse} = 0 then 1.0 else 0.0 end else 1 - {sse} / {sst} end")


def _rmse_sql(y, p):
    return f"sqrt(avg(({y} - {p}) * ({y} - {p})))"


def _wmape_pos_sql(y, p):
    return (f"sum(abs({y} - {p})) filter (where {y} > 0) / "
            f"nullif(sum({y}) filter (where {y} > 0), 0) * 100")


def hv_frame(spark, d):
    return S.high_volume(weekly_v2(spark, d), P.THRESHOLD, P.EXCLUDE)


def naive_frame(spark, d, parity: bool = False):
    hv = hv_frame(spark, d)
    split = S.add_split(hv, "week_start", P.TEST_CUT)
    side = "test" if parity else "train"
    fill = split.filter(F.col("split") == side).agg(F.avg("sum_Quantite").alias("_fill"))
    test = split.filter(F.col("split") == "test").crossJoin(F.broadcast(fill))
    return (EV.naive_seasonal(test, F.col("_fill"))
            .select("week_start", "Famille", F.col("sum_Quantite").alias("y"), "p"))


def store_frame(spark, d):
    """The store features a selection reads twice (once to rank the families), computed once."""
    return materialize(FE.store_features(clean_frame(spark, d, MART_COLS), with_dominant=False,
                                         stores=store_country(spark, d)).select(
        "Date", "CodeMag", "Famille", "Pays", "sum_Quantite"))


# ------------------------------------------------------------------ selection

register("high_volume_filter", f"""{HV_SQL}
select Famille, year, week_of_year, week_start, round(sum_Quantite, 6) as sum_Quantite from hv""")(
    lambda spark, d: rounded(hv_frame(spark, d).select("Famille", "year", "week_of_year", "week_start",
                                                        "sum_Quantite")))

register("top10_then_min", f"""{STORE_SQL},
top as (select Famille from sf where Famille is not null group by Famille
        order by sum(sum_Quantite) desc, Famille limit {P.TOP_K})
select Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite
from sf where Famille in (select Famille from top) and sum_Quantite >= 2""")(
    lambda spark, d: rounded(S.top_then_min(store_frame(spark, d), P.TOP_K, 2)))

register("min_then_top10", f"""{STORE_SQL},
f as (select * from sf where sum_Quantite >= 2),
top as (select Famille from f where Famille is not null group by Famille
        order by sum(sum_Quantite) desc, Famille limit {P.TOP_K})
select Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite
from f where Famille in (select Famille from top)""")(
    lambda spark, d: rounded(S.min_then_top(store_frame(spark, d), P.TOP_K, 2)))

register("country_min_then_top", f"""{STORE_SQL},
f as (select * from sf where Pays = '{P.COUNTRY}' and sum_Quantite >= 2),
top as (select Famille from f where Famille is not null group by Famille
        order by sum(sum_Quantite) desc, Famille limit {P.TOP_K})
select Date, CodeMag, Famille, Pays, round(sum_Quantite, 6) as sum_Quantite
from f where Famille in (select Famille from top)""")(
    lambda spark, d: rounded(S.min_then_top(store_frame(spark, d), P.TOP_K, 2, country=P.COUNTRY)))

register("split_counts", f"""{HV_SQL}
select case when week_start < DATE '{P.TEST_CUT}' then 'train' else 'test' end as split,
       count(*) as "rows", min(week_start) as date_min, max(week_start) as date_max
from hv group by 1""")(lambda spark, d: S.split_counts(hv_frame(spark, d), "week_start", P.TEST_CUT))

register("group_guard", f"""{HV_SQL}
select Famille, train_rows, test_rows, train_rows >= 10 and test_rows >= 1 as kept from (
  select Famille, cast(count_if(week_start < DATE '{P.TEST_CUT}') as bigint) as train_rows,
         cast(count_if(week_start >= DATE '{P.TEST_CUT}') as bigint) as test_rows
  from hv group by Famille) t""")(
    lambda spark, d: S.group_sizes(hv_frame(spark, d), "week_start", P.TEST_CUT, 10, 1))

register("value_counts_top", f"""{HV_SQL}
select Famille, count(*) as "count" from hv where Famille is not null group by Famille
order by "count" desc, Famille limit 10""")(lambda spark, d: S.value_counts_top(hv_frame(spark, d), "Famille", 10))


# ------------------------------------------------------------------ naive model and metrics

register("naive_predict", f"""{HV_SQL}
select week_start, Famille, round(y, 6) as y, round(p, 6) as p from naive""")(
    lambda spark, d: rounded(naive_frame(spark, d)))


@register("metrics_overall", f"""{HV_SQL}
select count(*) as n, round({_rmse_sql('y', 'p')}, 6) as RMSE, round({_r2_sql('y', 'p')}, 6) as R2,
       round(avg(abs(y - p) / greatest(abs(y), {FLOAT_EPS})) * 100, 6) as MAPE,
       round(avg(case when y >= 5 then abs((y - p) / y) end) * 100, 6) as MAPE_5,
       round(sum(abs(y - p)) / nullif(sum(y), 0) * 100, 6) as WMAPE_all,
       round({_wmape_pos_sql('y', 'p')}, 6) as WMAPE
from naive""")
def q_metrics_overall(spark, d):
    return rounded(naive_frame(spark, d).agg(*EV.metric_columns("y", "p")))


register("metrics_by_family", f"""{HV_SQL}
select Famille, round({_rmse_sql('y', 'p')}, 2) as RMSE, round({_wmape_pos_sql('y', 'p')}, 2) as WMAPE,
       round({_r2_sql('y', 'p')}, 4) as R2
from naive group by Famille""")(lambda spark, d: EV.evaluate(naive_frame(spark, d), "y", "p", by=["Famille"]))


@register("metrics_macro", f"""{HV_SQL}, per as (
  select Famille, {_rmse_sql('y', 'p')} as RMSE,
         coalesce(avg(case when y >= 5 then abs((y - p) / y) end) * 100, 999.0) as MAPE,
         {_r2_sql('y', 'p')} as R2
  from naive group by Famille)
select round(avg(MAPE), 6) as avg_MAPE, round(avg(R2), 6) as avg_R2, round(avg(RMSE), 6) as avg_RMSE,
       count(*) as n_groups from per""")
def q_metrics_macro(spark, d):
    per = EV.per_group_metrics(naive_frame(spark, d), "Famille", mape_empty=999.0)
    return rounded(EV.macro_average(per, ["MAPE", "R2", "RMSE"]))


@register("model_rank", f"""{HV_SQL}, long as (
  select 'Naive (lag_52)' as model, y, p from naive
  union all select 'Naive (lag_52, test mean)' as model, y, p_test_mean as p from naive)
select model, round({_rmse_sql('y', 'p')}, 2) as RMSE, round({_wmape_pos_sql('y', 'p')}, 2) as WMAPE,
       round({_r2_sql('y', 'p')}, 4) as R2
from long group by model""")
def q_model_rank(spark, d):
    a = naive_frame(spark, d).withColumn("model", F.lit("Naive (lag_52)"))
    b = naive_frame(spark, d, parity=True).withColumn("model", F.lit("Naive (lag_52, test mean)"))
    return EV.compare_models(a.unionByName(b))
