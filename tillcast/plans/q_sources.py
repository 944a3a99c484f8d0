"""Source, sink and registry queries: checked CSV, versioned tables, model registry, model choice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillcast import constants as K
from tillcast.operators import evaluate as EV
from tillcast.operators import marts as M
from tillcast.operators import select as S
from tillcast.operators.scoring import model_status
from tillcast.plans import params as P
from tillcast.plans.catalog import WITH_SALES, clean_frame, register, rounded
from tillcast.plans.q_features import WEEK_COLS, WEEKLY_COUNTRY, WEEKLY_SQL
from tillcast.plans.q_models import _FIXED_SUM, FIXED_INTERCEPT, KEYS, _fixed_model, weekly_tables
from tillcast.plans.q_select import HV_SQL, _r2_sql, _rmse_sql, _wmape_pos_sql
from tillcast.session import checkpoint_dir, materialize
from tillcast.sources.sinks import write_csv
from tillcast.sources.tables import read_csv_checked, sales
from tillcast.sources.versions import history, publish, read_version

CSV_SCHEMA = "l_orderkey bigint, l_linenumber int, Date date, Quantite double, Total double"
CSV_COLS = ["l_orderkey", "l_linenumber", "Date", "Quantite", "Total"]


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written_lines(spark, d):
    """The sales lines as CSV with a header, and the lines of every 50th order once more as damaged text."""
    lines = sales(spark, d, CSV_COLS)
    root = _folder(spark, "csv")
    write_csv(lines, f"{root}/lines")
    kind = F.col("l_orderkey") % 50
    head = F.concat_ws(",", "l_orderkey", "l_linenumber")
    damaged = (F.when(kind == 0, F.concat(head, F.lit(",1996-02-31,1.0,2.0")))
               .when(kind == 1, F.concat(head, F.lit(",1996-02-28,n/a,2.0")))
               .when(kind == 2, head)
               .when(kind == 3, F.concat(head, F.lit(",1996-02-28,1.0,2.0,more"))))
    lines.filter(kind <= 3).select(damaged.alias("value")).write.text(f"{root}/damaged")
    good, bad = read_csv_checked(spark, f"{root}/lines", CSV_SCHEMA)
    good2, bad2 = read_csv_checked(spark, f"{root}/damaged", CSV_SCHEMA, header=False)
    return good.unionByName(good2), bad.unionByName(bad2)


@register("csv_roundtrip", f"""{WITH_SALES}
select l_orderkey, l_linenumber, Date, round(Quantite, 6) as Quantite, round(Total, 6) as Total from sales""")
def q_csv_roundtrip(spark, d):
    """S5 + S3 + X17: all sales lines written as CSV, read back by schema; the damaged lines beside them are rejected."""
    return rounded(_written_lines(spark, d)[0])


@register("csv_rejects", f"""{WITH_SALES}, bad as (
  select l_orderkey % 50 as kind, concat(l_orderkey, ',', l_linenumber) as head from sales where l_orderkey % 50 <= 3)
select case kind when 0 then 'Date' when 1 then 'Quantite' else 'fields' end as reason,
       concat(head, case kind when 0 then ',1996-02-31,1.0,2.0' when 1 then ',1996-02-28,n/a,2.0'
                    when 3 then ',1996-02-28,1.0,2.0,more' else '' end) as record from bad""")
def q_csv_rejects(spark, d):
    """S3 + X17: the rejected lines with their reasons: no such day, no number, too few or too many fields."""
    return _written_lines(spark, d)[1]


# ------------------------------------------------------------------ versioned tables

@register("published_versions", f"""{WEEKLY_SQL}
select 1 as version, count(*) as row_count, count(*) as "rows", round(sum(sum_Quantite), 6) as sum_Quantite
from weekly where week_start < DATE '{P.TEST_CUT}'
union all select 2, count(*), count(*), round(sum(sum_Quantite), 6) from weekly""")
def q_published_versions(spark, d):
    """The weekly mart published twice, first to the test cut, then whole:
    each version as its readers see it, beside the row count of its commit."""
    mart = materialize(M.weekly_mart(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY))
    root = _folder(spark, "weekly")
    publish(mart.filter(F.col("week_start") < P.TEST_CUT), root)
    publish(mart, root, sort_within=["Famille", "week_start"])
    read = [read_version(spark, root, v).agg(F.count(F.lit(1)).alias("rows"), F.sum("sum_Quantite").alias("sum_Quantite"))
            .withColumn("version", F.lit(n)) for v, n in ((1, 1), (None, 2))]
    seen = read[0].unionByName(read[1]).join(history(spark, root), "version")
    return rounded(seen.select("version", "row_count", "rows", "sum_Quantite"))


# ------------------------------------------------------------------ model choice

# models whose predictions SQL can compute, by name; the naive one is left out of the choice
MODELS = {"Naive (lag_52)": "pred_naive", "Lag 1": "pred_lag_1", "Mean 12": "pred_mean_12", "Fixed": "pred_fixed"}
EXCLUDED = ["Naive (lag_52)"]

MODELS_SQL = f"""{HV_SQL}, preds as (
  select week_start, Famille, sum_Quantite as y, coalesce(lag_52, (select m from trainmean)) as pred_naive,
         lag_1 as pred_lag_1, rolling_mean_12 as pred_mean_12, greatest({FIXED_INTERCEPT!r} + {_FIXED_SUM}, 0.0) as pred_fixed
  from hv where week_start >= DATE '{P.TEST_CUT}'),
long as ({" union all ".join(f"select Famille, y, '{m}' as model, {c} as p from preds" for m, c in MODELS.items())}),
ranking as (select model, round({_rmse_sql('y', 'p')}, 2) as RMSE, round({_wmape_pos_sql('y', 'p')}, 2) as WMAPE,
                   round({_r2_sql('y', 'p')}, 4) as R2 from long group by model),
best as (select model as best_model from ranking where model not in ({", ".join(f"'{m}'" for m in EXCLUDED)})
         order by WMAPE, model limit 1)"""


def _predictions(spark, d):
    """(test rows with a column per model, high-volume rows)."""
    hv = materialize(weekly_tables(spark, d)[1])
    split = S.add_split(hv, "week_start", P.TEST_CUT)
    fill = split.filter("split = 'train'").agg(F.avg(K.TARGET).alias("_fill"))
    test = split.filter("split = 'test'").join(F.broadcast(fill))
    fixed = F.greatest(_fixed_model().predict_col(), F.lit(0.0))
    return test.select(*KEYS, F.col(K.TARGET).alias("y"), F.coalesce("lag_52", "_fill").alias("pred_naive"),
                       F.col("lag_1").alias("pred_lag_1"), F.col("rolling_mean_12").alias("pred_mean_12"),
                       fixed.alias("pred_fixed")), hv


def _long(preds):
    return EV.long_predictions(preds, KEYS, "y", {m: c for m, c in MODELS.items()})


@register("predictions_wide", f"""{MODELS_SQL}
select week_start, Famille, round(y, 6) as y, {", ".join(f'round({c}, 6) as "pred_{m}"' for m, c in MODELS.items())} from preds""")
def q_predictions_wide(spark, d):
    """The long predictions of four models pivoted to one row per family and week."""
    return rounded(EV.wide_predictions(_long(_predictions(spark, d)[0]), KEYS, "y", list(MODELS)))


register("model_ranking", f"{MODELS_SQL} select * from ranking")(
    lambda spark, d: EV.compare_models(_long(_predictions(spark, d)[0])))

register("best_model_by_family", f"""{MODELS_SQL}
select best_model, Famille, round({_rmse_sql('y', 'p')}, 2) as RMSE, round({_wmape_pos_sql('y', 'p')}, 2) as WMAPE,
       round({_r2_sql('y', 'p')}, 4) as R2
from long join best on model = best_model group by best_model, Famille""")(
    lambda spark, d: EV.chosen_model_metrics(_long(_predictions(spark, d)[0]), "Famille", EXCLUDED))


@register("model_registry", f"""{MODELS_SQL}
select 2 as version, '{K.MODEL_STATUS}' as status, model as model_name, WMAPE as wmape, R2 as r2,
       (select cast(max(week_start) as varchar) from hv where week_start < DATE '{P.TEST_CUT}') as last_trained,
       (select string_agg(distinct Famille, ',' order by Famille) from hv) as families_supported
from ranking where model = 'Fixed'""")
def q_model_registry(spark, d):
    """M12 + M14: status rows of two models published one after the other; the reader serves the newest."""
    preds, hv = _predictions(spark, d)
    preds = materialize(preds)
    root = _folder(spark, "registry")
    last = hv.filter(F.col("week_start") < P.TEST_CUT).agg(F.max("week_start").cast("string")).first()[0]
    for name in ("Lag 1", "Fixed"):
        m = EV.evaluate(preds, "y", MODELS[name]).first()
        row = model_status(hv.select("Famille").distinct(), m["WMAPE"], m["R2"], F.lit(last).cast("string"), name)
        publish(row, root)
    newest = history(spark, root).agg(F.max("version").alias("version"))
    return read_version(spark, root).join(F.broadcast(newest)).withColumn(
        "families_supported", F.array_join("families_supported", ","))
