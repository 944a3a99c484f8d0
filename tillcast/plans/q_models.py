"""Model, comparison and scoring queries.

All models train on the weekly v2 feature table after the high-volume filter
(C1), split in time at the test cut; the tree models use the reference's
settings.  Its round counts are upper limits: growing fits end as soon as the
patience rule has fired, with the round that the full fit would give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillcast import constants as K
from tillcast.operators import boosting as BO
from tillcast.operators import evaluate as EV
from tillcast.operators import models as MD
from tillcast.operators import seasonal as SE
from tillcast.operators import select as S
from tillcast.operators.encode import code_table
from tillcast.operators.scoring import model_status, score, split_scored
from tillcast.plans import params as P
from tillcast.plans.catalog import clean_frame, register, rounded
from tillcast.plans.q_features import STORE_FEAT_SQL, WEEK_COLS, WEEKLY_COUNTRY, WEEKLY_V1_SQL, _sq, weekly_v2
from tillcast.plans.q_select import HV_SQL
from tillcast.session import checkpoint_dir, materialize

# fixed values: most rounds, rounds without improvement, forest trees
GBT_ROUNDS = 1000
GBT_ROUNDS_PER_FAMILY = 500
GBT_PATIENCE = 50
GBT_PATIENCE_TOP_FAMILIES = 30
RF_TREES = 300

# fixed coefficients in the order of WEEKLY_FEATURES_15, so that SQL can
# compute every prediction of the scorer
FIXED_INTERCEPT = -120.0
FIXED_COEF = [0.0625, -0.5, 1.25, -2.0, 6.0, 3.5, -4.0, 8.0, 0.75, 0.25, 0.125, 0.0625, 0.1875, 0.25, 0.125]
KEYS = ["week_start", "Famille"]


def _split(df, cut=P.TEST_CUT):
    s = S.add_split(df, "week_start", cut)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


def _out(pred, col="prediction"):
    return rounded(pred.select(*KEYS, K.TARGET, F.col(col).alias("predicted_Quantite")))


def weekly_tables(spark, d):
    """(v2 features, high-volume subset), the first written once to the
    checkpoint folder: fits, predictions, code table and requests all read it."""
    v2 = materialize(weekly_v2(spark, d))
    return v2, S.high_volume(v2, P.THRESHOLD, P.EXCLUDE)


def ridge_global_parts(spark, d, standardize=True, tables=None):
    v2, hv = tables or weekly_tables(spark, d)
    train, test = _split(hv)
    model = MD.fit_ridge(train, K.WEEKLY_FEATURES_15, K.TARGET, K.RIDGE_ALPHA, standardize)
    pred = test.withColumn("prediction", F.when(model.predict_col() < 0, 0.0).otherwise(model.predict_col()))
    return model, hv, pred


@register("ridge_global")
def q_ridge_global(spark, d):
    """M1 + M2 + M15: standardised global ridge, test rows with predictions."""
    _, _, pred = ridge_global_parts(spark, d)
    return _out(pred)


@register("ridge_per_family")
def q_ridge_per_family(spark, d):
    """M4 + P15 (10 train rows, 1 test row): one ridge per family."""
    hv = S.guard_groups(weekly_tables(spark, d)[1], "week_start", P.TEST_CUT, 10, 1)
    train, test = _split(hv)
    coefs = MD.fit_ridge_by_group(train, "Famille", K.WEEKLY_FEATURES_PER_FAMILY, K.TARGET)
    pred = MD.predict_by_group(test, coefs, "Famille", K.WEEKLY_FEATURES_PER_FAMILY)
    return _out(pred.withColumn("prediction", F.when(F.col("prediction") < 0, 0.0).otherwise(F.col("prediction"))))


@register("ridge_optimality", f"""{HV_SQL}
select term, (select count(*) from hv where week_start < DATE '{P.TEST_CUT}') as n, 0.0::double as gradient
from (values {", ".join(f"('{t}')" for t in ["intercept", *K.WEEKLY_FEATURES_15])}) t(term)""")
def q_ridge_optimality(spark, d):
    """M1 + M2: train rows and, per term, the gradient of the fitted global
    ridge's loss, which is 0 at the one optimum."""
    model, hv, _ = ridge_global_parts(spark, d)
    train = _split(hv)[0].withColumn("_p", model.predict_col())
    coef = {f: F.lit(float(b)) for f, b in zip(model.features, model.coef)}
    return rounded(MD.ridge_gradient(train, K.WEEKLY_FEATURES_15, K.TARGET, "_p", coef))


@register("ridge_family_optimality", f"""{HV_SQL}, g as (
  select Famille, count(*) filter (where week_start < DATE '{P.TEST_CUT}') as n,
         count(*) filter (where week_start >= DATE '{P.TEST_CUT}') as n_test from hv group by Famille)
select Famille, term, n, 0.0::double as gradient
from g, (values {", ".join(f"('{t}')" for t in ["intercept", *K.WEEKLY_FEATURES_PER_FAMILY])}) t(term)
where n >= 10 and n_test >= 1""")
def q_ridge_family_optimality(spark, d):
    """M4 + P15: the same check for the ridge of every guarded family."""
    hv = S.guard_groups(weekly_tables(spark, d)[1], "week_start", P.TEST_CUT, 10, 1)
    train, feats = _split(hv)[0], K.WEEKLY_FEATURES_PER_FAMILY
    coefs = materialize(MD.fit_ridge_by_group(train, "Famille", feats, K.TARGET))
    fitted = (MD.predict_by_group(train, coefs, "Famille", feats, "_p")
              .join(coefs.drop("n", "intercept"), "Famille"))
    return rounded(MD.ridge_gradient(fitted, feats, K.TARGET, "_p", {f: F.col(f"b_{f}") for f in feats}, by=["Famille"]))


@register("ridge_vs_baseline")
def q_ridge_vs_baseline(spark, d):
    """E7 + E10: overall metrics of the per-family ridge against the WMAPE
    that the global ridge has on the same test weeks."""
    baseline = EV.evaluate(q_ridge_global(spark, d), K.TARGET, "predicted_Quantite").first()["WMAPE"]
    metrics = EV.evaluate(q_ridge_per_family(spark, d), K.TARGET, "predicted_Quantite")
    return EV.change_against_baseline(metrics, baseline)


def gbt_global_parts(spark, d):
    """M5 (V8 settings): 14 features, test from the late cut, depth 5, rate .05."""
    hv = weekly_tables(spark, d)[1]
    train, test = _split(hv, P.TEST_CUT_LATE)
    model, rounds = MD.fit_gbt(train, K.WEEKLY_FEATURES_14_V8, K.TARGET, max_iter=GBT_ROUNDS, step=0.05,
                               depth=5, patience=GBT_PATIENCE, date_col="week_start")
    return model, MD.predict_ml(model, test, K.WEEKLY_FEATURES_14_V8)


register("gbt_global")(lambda spark, d: _out(gbt_global_parts(spark, d)[1].withColumn(
    "prediction", F.when(F.col("prediction") < 0, 0.0).otherwise(F.col("prediction")))))


def weekly_family_rows(spark, d):
    """M6 (V6): weekly v1 features of families with 10 train / 3 test rows, with each row's role."""
    from tillcast.operators.features import weekly_features_v1
    v1 = weekly_features_v1(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY)
    v1 = S.guard_groups(materialize(v1), "week_start", P.TEST_CUT_LATE, 10, 3)
    return materialize(BO.hold_out_last(v1, "Famille", "week_start", P.TEST_CUT_LATE))


@register("gbt_per_family")
def q_gbt_per_family(spark, d):
    """M6 (V6 settings): weekly v1 features, one model per family, depth 4,
    guard 10 train / 3 test rows, test from the late cut."""
    from tillcast.operators.features import weekly_features_v1
    v1 = weekly_features_v1(clean_frame(spark, d, WEEK_COLS), WEEKLY_COUNTRY)
    v1 = materialize(S.guard_groups(v1, "week_start", P.TEST_CUT_LATE, 10, 3))
    train, test = _split(v1, P.TEST_CUT_LATE)
    families = [r[0] for r in v1.select("Famille").distinct().orderBy("Famille").collect()]
    pred = MD.fit_gbt_by_group(train, test, "Famille", K.WEEKLY_FEATURES_13, K.TARGET, families,
                               max_iter=GBT_ROUNDS_PER_FAMILY, step=0.05, depth=4, patience=GBT_PATIENCE,
                               date_col="week_start")
    return _out(pred.withColumn("prediction", F.when(F.col("prediction") < 0, 0.0).otherwise(F.col("prediction"))))


def rf_parts(spark, d):
    hv = weekly_tables(spark, d)[1]
    train, test = _split(hv)
    model = MD.fit_random_forest(train, K.WEEKLY_FEATURES_15, K.TARGET, trees=RF_TREES, depth=8)
    return model, MD.predict_ml(model, test, K.WEEKLY_FEATURES_15)


register("random_forest")(lambda spark, d: _out(rf_parts(spark, d)[1]))


def seasonal_split(spark, d, hv=None):
    """Train and test weeks of the families that pass the guard (10 train rows, 1 test row)."""
    hv = hv if hv is not None else weekly_tables(spark, d)[1]
    return _split(S.guard_groups(hv, "week_start", P.TEST_CUT, 10, 1))


def seasonal_parts(spark, d, hv=None):
    train, test = seasonal_split(spark, d, hv)
    return SE.changepoint_trend(train, test, "Famille", "week_start", K.TARGET)


register("seasonal_trend")(lambda spark, d: _out(seasonal_parts(spark, d)))


@register("seasonal_optimality", f"""{HV_SQL}, g as (
  select Famille, count(*) filter (where week_start < DATE '{P.TEST_CUT}') as n,
         count(*) filter (where week_start >= DATE '{P.TEST_CUT}') as n_test,
         date_diff('day', min(week_start), max(week_start) filter (where week_start < DATE '{P.TEST_CUT}')) as width
  from hv group by Famille)
select Famille, term, round({K.CHANGEPOINT_RANGE} * j * width / {K.CHANGEPOINTS}, 6)::double as at_day, n, 0.0::double as violation
from g, (values {", ".join(f"('{t}', {t.split('_')[1] if t.startswith('change_') else 'null'})" for t in SE.TERMS)}) t(term, j)
where n >= 10 and n_test >= 1""")
def q_seasonal_optimality(spark, d):
    """M9 + P15: places of the changepoints and, per family and term, by how
    much the fit misses the optimality conditions of its prior (0 at the optimum)."""
    train, _ = seasonal_split(spark, d)
    fitted = materialize(SE.fit_changepoint_trend(train, "Famille", "week_start", K.TARGET))
    return rounded(SE.optimality(train, fitted, "Famille", "week_start", K.TARGET))


@register("feature_importance")
def q_feature_importance(spark, d):
    """Importances of the global GBT, sorted descending."""
    model, _ = gbt_global_parts(spark, d)
    return MD.feature_importance(model, K.WEEKLY_FEATURES_14_V8, spark)


@register("model_comparison")
def q_model_comparison(spark, d):
    """E9 + K7: raw-feature ridge (M3), GBT, random forest, seasonal trend
    and the naive baseline on the same test rows, ranked by WMAPE."""
    from tillcast.plans.q_select import naive_frame
    hv = weekly_tables(spark, d)[1]
    train, test = _split(hv)
    ridge = MD.fit_ridge(train, K.WEEKLY_FEATURES_15, K.TARGET, K.RIDGE_ALPHA, standardize=False)
    gbt, _ = MD.fit_gbt(train, K.WEEKLY_FEATURES_15, K.TARGET, max_iter=GBT_ROUNDS, depth=5,
                        patience=GBT_PATIENCE, date_col="week_start")
    rf = MD.fit_random_forest(train, K.WEEKLY_FEATURES_15, K.TARGET, trees=RF_TREES, depth=8)
    base = test.withColumn("p_ridge", ridge.predict_col())
    base = MD.predict_ml(gbt, base, K.WEEKLY_FEATURES_15, "p_gbt")
    base = MD.predict_ml(rf, base, K.WEEKLY_FEATURES_15, "p_rf")
    long = EV.long_predictions(base.withColumnRenamed(K.TARGET, "y"), KEYS, "y",
                               {"Ridge": "p_ridge", "GBT": "p_gbt", "RandomForest": "p_rf"})
    seas = seasonal_parts(spark, d, hv).select(*KEYS, F.col(K.TARGET).alias("y"), F.lit("SeasonalTrend").alias("model"),
                                           F.col("prediction").alias("p"))
    naive = naive_frame(spark, d).select(*KEYS, "y", F.lit("Naive (lag_52)").alias("model"), "p")
    return EV.compare_models(long.unionByName(seas).unionByName(naive), y="y")


# ------------------------------------------------------------------ scoring

def _requests(v2):
    """Requests built from the test weeks of every family (the ones the model
    does not serve become rejects)."""
    _, test = _split(v2)
    return test.select(F.col("Famille").alias("famille"), "year", "week_of_year", "lag_1", "lag_2", "lag_4",
                       "lag_52", "rolling_mean_4", "rolling_mean_12")


def _scoring_inputs(spark, d):
    tables = weekly_tables(spark, d)
    model, hv, _ = ridge_global_parts(spark, d, tables=tables)
    codes = code_table(tables[0], "Famille")
    supported = hv.select("Famille").distinct()
    return model, codes, supported, tables[0]


def _scored(spark, d):
    model, codes, supported, v2 = _scoring_inputs(spark, d)
    return score(_requests(v2), model, codes, supported, P.SUMMER_FAMILIES, P.WINTER_FAMILIES)


register("score_requests")(lambda spark, d: split_scored(_scored(spark, d))[0])

register("score_rejects", f"""{HV_SQL}, sup as (select distinct Famille from hv),
choices as (select '[' || string_agg('''' || Famille || '''', ', ' order by Famille) || ']' as c from sup),
req as (select Famille as famille, year, week_of_year from v2 where week_start >= DATE '{P.TEST_CUT}')
select famille, year, week_of_year,
       'Famille ''' || famille || ''' not supported. Choose from: ' || c as error
from req, choices where famille not in (select Famille from sup)""")(
    lambda spark, d: split_scored(_scored(spark, d))[1])


def _fixed_model():
    return MD.LinearModel(K.WEEKLY_FEATURES_15, FIXED_INTERCEPT, FIXED_COEF)


_FIXED_SUM = " + ".join(f"{b!r} * {f}" for f, b in zip(K.WEEKLY_FEATURES_15, FIXED_COEF))


@register("score_fixed_model", f"""{HV_SQL}, sup as (select distinct Famille as sfam from hv),
choices as (select '[' || coalesce(string_agg('''' || sfam || '''', ', ' order by sfam), '') || ']' as c from sup),
codes as (select distinct Famille as fam, Famille_encoded from v2),
base as (select Famille as famille, year, week_of_year, lag_1, lag_2, lag_4, lag_52, rolling_mean_4, rolling_mean_12
         from v2 where week_start >= DATE '{P.TEST_CUT}'),
req as (select * from base union all
        select famille, year, 53 as week_of_year, lag_1, lag_2, lag_4, lag_52, rolling_mean_4, rolling_mean_12
        from base where week_of_year = 52),
mon as (select *, cast(date_trunc('week', make_date(year, 1, 4)) as date) + cast((week_of_year - 1) * 7 as integer) as m
        from req),
x as (select *, isoyear(m) = year and week(m) = week_of_year as valid, month(m) as month, quarter(m) as quarter,
        cast(month(m) in ({", ".join(map(str, K.SUMMER_MONTHS))}) as int) as is_summer,
        cast(month(m) in ({", ".join(map(str, K.WINTER_MONTHS))}) as int) as is_winter,
        cast(month(m) in ({", ".join(map(str, K.SOLDES_MONTHS))}) as int) as is_soldes from mon),
y as (select x.*, codes.Famille_encoded, sfam is not null as known,
        cast((famille in ({_sq(P.SUMMER_FAMILIES)}) and is_summer = 1)
             or (famille in ({_sq(P.WINTER_FAMILIES)}) and is_winter = 1) as int) as is_high_season
      from x left join codes on fam = famille left join sup on sfam = famille)
select famille, year, week_of_year,
       case when known and valid then round(greatest({FIXED_INTERCEPT!r} + {_FIXED_SUM}, 0.0), 2) end as predicted_quantity,
       case when not known then 'Famille ''' || famille || ''' not supported. Choose from: ' || c
            when not valid then 'Invalid ISO week: ' || year || '-W' || week_of_year end as error
from y, choices""")
def q_score_fixed_model(spark, d):
    """M13 + X8: the scorer with fixed coefficients over the test weeks of
    every family, and a week 53 asked for in each year that has a week 52."""
    v2, hv = weekly_tables(spark, d)
    base = _requests(v2)
    requests = base.unionByName(base.filter("week_of_year = 52").withColumn("week_of_year", F.lit(53)))
    return score(requests, _fixed_model(), code_table(v2, "Famille"), hv.select("Famille").distinct(),
                 P.SUMMER_FAMILIES, P.WINTER_FAMILIES)


@register("score_stream")
def q_score_stream(spark, d):
    """M13 on a stream: requests written as files, read with readStream,
    scored and written per micro-batch; returns what the stream wrote."""
    from tillcast.streaming.scoring_stream import read_predictions, start_scoring
    model, codes, supported, v2 = _scoring_inputs(spark, d)
    run = f"{checkpoint_dir(spark).rstrip('/')}/score-stream-{uuid.uuid4().hex}"
    _requests(v2).write.mode("overwrite").parquet(f"{run}/requests")
    q = start_scoring(spark, f"{run}/requests", f"{run}/out", model, codes, supported,
                      name=f"scoring_{uuid.uuid4().hex[:8]}", summer_families=P.SUMMER_FAMILIES,
                      winter_families=P.WINTER_FAMILIES)
    q.awaitTermination()
    return read_predictions(spark, f"{run}/out").drop("batch_id")


@register("model_status")
def q_model_status(spark, d):
    """Status row of the served model, with the WMAPE and R2 measured
    on the test weeks, the sorted family list and the last week it learnt from."""
    _, hv, pred = ridge_global_parts(spark, d)
    m = EV.evaluate(pred, K.TARGET, "prediction").first()
    last = _split(hv)[0].agg(F.max("week_start").cast("string")).first()[0]
    return model_status(hv.select("Famille").distinct(), float(m["WMAPE"]) if m["WMAPE"] is not None else None,
                        float(m["R2"]) if m["R2"] is not None else None, F.lit(last).cast("string"))


@register("scaler_stats", f"""{HV_SQL}
select * from (""" + " union all ".join(
    f"""select '{f}' as feature, round(avg({f}), 6) as mean,
       round(case when stddev_pop({f}) < 2.220446049250313e-15 then 1.0 else stddev_pop({f}) end, 6) as scale
from hv where week_start < DATE '{P.TEST_CUT}'""" for f in K.WEEKLY_FEATURES_15) + ") t")
def q_scaler_stats(spark, d):
    """M1: mean and population std (0 -> 1) of the 15 features on the train rows."""
    train, _ = _split(weekly_tables(spark, d)[1])
    return rounded(MD.scaler_stats(train, K.WEEKLY_FEATURES_15))


@register("model_save_load")
def q_model_save_load(spark, d):
    """Fit the global ridge, save coefficients and the code table to the
    checkpoint folder, load them back and return the loaded coefficients."""
    tables = weekly_tables(spark, d)
    model, _, _ = ridge_global_parts(spark, d, tables=tables)
    codes = code_table(tables[0], "Famille")
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    MD.save_linear(model, spark, path, codes)
    loaded, _ = MD.load_linear(spark, path)
    rows = [("intercept", float(loaded.intercept))] + list(zip(loaded.features, map(float, loaded.coef)))
    return spark.createDataFrame(rows, "term string, coefficient double")


# ------------------------------------------------------------------ daily-feature tree models

@register("gbt_store_daily")
def q_gbt_store_daily(spark, d):
    """M5 (V2 order and settings) on the store-day features: top families
    first, then targets >= 2, 17 features, depth 6, patience 50; test rows
    with predictions."""
    from tillcast.operators.features import store_features
    from tillcast.plans.q_features import MART_COLS
    from tillcast.sources.tables import store_country
    feats = materialize(S.top_then_min(store_features(clean_frame(spark, d, MART_COLS), with_dominant=False,
                                                      stores=store_country(spark, d)), P.TOP_K, 2))
    s = S.add_split(feats, "Date", P.TEST_CUT)
    train, test = s.filter("split = 'train'"), s.filter("split = 'test'")
    model, _ = MD.fit_gbt(train, K.DAILY_FEATURES_17, K.TARGET, max_iter=GBT_ROUNDS, step=0.05, depth=6,
                          patience=GBT_PATIENCE, date_col="Date")
    pred = MD.predict_ml(model, test, K.DAILY_FEATURES_17)
    return rounded(pred.select("Date", "CodeMag", "Famille", "Pays", K.TARGET,
                               F.when(F.col("prediction") < 0, 0.0).otherwise(F.col("prediction"))
                               .alias("predicted_Quantite")))


@register("gbt_country_daily")
def q_gbt_country_daily(spark, d):
    """M6 (V5 settings) on the country-day features: one model per family,
    15 features, depth 6, guard 50 train / 10 test rows; per-family RMSE,
    MAPE (y >= 5, null when empty) and R2 with train/test sizes (E8 input)."""
    from tillcast.operators.features import country_daily_features
    from tillcast.plans.q_features import CDAY_COLS
    from tillcast.sources.tables import store_country
    feats = country_daily_features(clean_frame(spark, d, CDAY_COLS), P.COUNTRY, stores=store_country(spark, d))
    feats = materialize(S.guard_groups(feats, "Date", P.TEST_CUT, 50, 10))
    s = S.add_split(feats, "Date", P.TEST_CUT)
    train, test = s.filter("split = 'train'"), s.filter("split = 'test'")
    families = [r[0] for r in feats.select("Famille").distinct().orderBy("Famille").collect()]
    pred = MD.fit_gbt_by_group(train, test, "Famille", K.DAILY_FEATURES_15, K.TARGET, families,
                               max_iter=GBT_ROUNDS_PER_FAMILY, step=0.05, depth=6, patience=GBT_PATIENCE,
                               date_col="Date")
    sizes = S.group_sizes(feats, "Date", P.TEST_CUT, 50, 10).select("Famille", "train_rows", "test_rows")
    per = EV.per_group_metrics(pred, "Famille", K.TARGET, "prediction", split_sizes=sizes)
    return rounded(per)


# ------------------------------------------------------------------ one model per top family (V3, V4)

def top_family_rows(spark, d, country=None):
    """M6 (V3; V4 with a country): targets >= 2, the top families, guard 100 train / 10 test
    rows, each row's role; validation rows are the last fifth of a family's training rows."""
    from tillcast.operators.features import store_features
    from tillcast.plans.q_features import MART_COLS
    from tillcast.sources.tables import store_country
    feats = materialize(store_features(clean_frame(spark, d, MART_COLS), with_dominant=False, stores=store_country(spark, d)))
    rows = S.guard_groups(S.min_then_top(feats, P.TOP_K, 2, country), "Date", P.TEST_CUT, 100, 10)
    return materialize(BO.hold_out_last(rows, "Famille", "Date", P.TEST_CUT))


def _top_family_model(spark, d, features, country=None):
    model = BO.fit_boosting(top_family_rows(spark, d, country), "Famille", features, K.TARGET, GBT_ROUNDS, step=0.05, depth=5,
                            patience=GBT_PATIENCE_TOP_FAMILIES)
    pred = model.predictions.filter(F.col("role") == BO.TEST)
    return rounded(pred.select("Date", "CodeMag", "Famille", "Pays", K.TARGET,
                               F.when(F.col("prediction") < 0, 0.0).otherwise(F.col("prediction")).alias("predicted_Quantite")))


register("gbt_top_families")(lambda spark, d: _top_family_model(spark, d, K.DAILY_FEATURES_16))
register("gbt_top_families_country")(lambda spark, d: _top_family_model(spark, d, K.DAILY_FEATURES_16_V4, P.COUNTRY))


def _root_split_sql(features, rows_sql, date_col, cut):
    """The best first split of every family of ``rows`` from all cuts and features, by joins of rows and cuts."""
    values = "\nunion all ".join(
        f"select Famille, y, {i} as f, '{f}' as feature, cast({f} as double) as x from fit" for i, f in enumerate(features))
    shares = ", ".join(repr(k / 32) for k in range(1, 32))
    return f"""{rows_sql},
train as (select *, {K.TARGET} as y from kept where {date_col} < DATE '{cut}'),
edge as (select Famille, quantile_disc({date_col}, 0.8) as e from train group by Famille),
fit as (select train.* from train join edge using (Famille) where {date_col} <= e),
base as (select Famille, avg(y) as base, count(*) as n from fit group by Famille),
vals as ({values}),
cuts as (select distinct Famille, f, feature, cut from (
  select Famille, f, feature, unnest(quantile_disc(x, [{shares}])) as cut from vals group by Famille, f, feature)),
sides as (select c.Famille, c.f, c.feature, c.cut, count(*) as nl, sum(v.y - b.base) as sl
          from cuts c join vals v on v.Famille = c.Famille and v.f = c.f and v.x <= c.cut join base b on b.Famille = c.Famille
          group by c.Famille, c.f, c.feature, c.cut),
gains as (select *, n - nl as nr, 0.5 * (sl * sl / (nl + 1) + sl * sl / (n - nl + 1)) as gain
          from sides join base using (Famille) where nl >= 1 and n - nl >= 1)
select Famille, feature, round(cut, 6) as cut, round(gain, 4) as gain, nl::bigint as nl, nr::bigint as nr, round(base, 6) as base from gains
qualify row_number() over (partition by Famille order by round(gain, 4) desc, f, cut) = 1"""


def _root_splits(rows, features):
    """M6: the first split of each family's first tree, over all features and fit rows."""
    rows = rows.filter(F.col("role") == BO.FIT)
    cuts = materialize(BO.quantile_cuts(rows, "Famille", features, K.TARGET))
    data = rows.join(cuts, "Famille").withColumn("bins", BO.binned(rows, features))
    data = data.select("Famille", F.lit(1).alias("node"), (F.col(K.TARGET) - F.col("base")).alias("res"), "bins",
                       F.expr(f"sequence(0, {len(features) - 1})").alias("chosen"))
    names = F.array(*[F.lit(f) for f in features])
    best = BO.best_splits(data, "Famille").join(cuts, "Famille")
    return rounded(best.select("Famille", F.get(names, F.col("split.f")).alias("feature"),
                               F.get(F.get("cuts", F.col("split.f")), F.col("split.b")).alias("cut"),
                               F.round("split.gain", 4).alias("gain"), "split.nl", "split.nr", "base"))


register("boost_root_splits", _root_split_sql(K.WEEKLY_FEATURES_13, f"""{WEEKLY_V1_SQL},
sizes as (select Famille from v1 group by Famille having count(*) filter (where week_start < DATE '{P.TEST_CUT_LATE}') >= 10
          and count(*) filter (where week_start >= DATE '{P.TEST_CUT_LATE}') >= 3),
kept as (select * from v1 where Famille in (select Famille from sizes))""", "week_start", P.TEST_CUT_LATE))(
    lambda spark, d: _root_splits(weekly_family_rows(spark, d), K.WEEKLY_FEATURES_13))

register("boost_root_splits_top", _root_split_sql(K.DAILY_FEATURES_16, f"""{STORE_FEAT_SQL},
sf as (select * from feat where lag_7 is not null and lag_14 is not null and lag_28 is not null and sum_Quantite >= 2),
top as (select Famille from sf where Famille is not null group by Famille order by sum(sum_Quantite) desc, Famille limit {P.TOP_K}),
sizes as (select Famille from sf where Famille in (select Famille from top) group by Famille
          having count(*) filter (where Date < DATE '{P.TEST_CUT}') >= 100 and count(*) filter (where Date >= DATE '{P.TEST_CUT}') >= 10),
kept as (select * from sf where Famille in (select Famille from sizes))""", "Date", P.TEST_CUT))(
    lambda spark, d: _root_splits(top_family_rows(spark, d), K.DAILY_FEATURES_16))
