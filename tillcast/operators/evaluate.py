"""Forecast metrics and model comparison.

Every metric is an aggregate expression over (y, p) columns, so evaluating
per family and overall is one ``groupBy().agg()`` and one ``agg()`` over the
prediction rows: no rows are brought back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.constants import FLOAT_EPS, MAPE_MIN_TARGET, MODEL_WMAPE
from tillcast.functions.scalars import clip_zero, round_to


def rmse(y: Column, p: Column) -> Column:
    """E1."""
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def r2(y: Column, p: Column) -> Column:
    """E2, scikit-learn's rule: 1 - SSE/SST; SST = 0 gives 1 if SSE = 0 else 0;
    fewer than two rows give NaN.  (Not ``regr_r2``, a squared correlation.)"""
    n = F.count(y)
    sse = F.sum(F.pow(y - p, 2))
    sst = F.var_pop(y) * n
    return (F.when(n < 2, F.lit(float("nan")))
            .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - sse / sst))


def mape_all(y: Column, p: Column) -> Column:
    """Scikit-learn MAPE in percent, ``|y-p| / max(|y|, eps)``."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(FLOAT_EPS))) * 100


def mape_min(y: Column, p: Column, minimum: float = MAPE_MIN_TARGET,
             empty: float | None = None) -> Column:
    """MAPE over rows with y >= minimum; ``empty`` when there are none
    (NaN in V2, 999 in V3/V4, null in V5/V6)."""
    m = F.avg(F.when(y >= minimum, F.abs((y - p) / y))) * 100
    return m if empty is None else F.coalesce(m, F.lit(float(empty)))


def wmape_all(y: Column, p: Column) -> Column:
    """E5: sum |y-p| / sum y, in percent."""
    return F.try_divide(F.sum(F.abs(y - p)), F.sum(y)) * 100


def wmape_positive(y: Column, p: Column) -> Column:
    """E5 over rows with y > 0."""
    pos = y > 0
    return F.try_divide(F.sum(F.when(pos, F.abs(y - p))), F.sum(F.when(pos, y))) * 100


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    """All metric variants, unrounded."""
    yc, pc = F.col(y), F.col(p)
    return [F.count(F.lit(1)).alias("n"), rmse(yc, pc).alias("RMSE"), r2(yc, pc).alias("R2"),
            mape_all(yc, pc).alias("MAPE"), mape_min(yc, pc).alias("MAPE_5"),
            wmape_all(yc, pc).alias("WMAPE_all"), wmape_positive(yc, pc).alias("WMAPE")]


def evaluate(preds: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None,
             clip: bool = True, wmape: str = "positive", rounded: bool = True) -> DataFrame:
    """Clip predictions at 0, then RMSE (2 decimals), WMAPE (2) and R2 (4),
    per group when ``by`` is given, else overall."""
    pc = clip_zero(F.col(p)) if clip else F.col(p)
    df = preds.withColumn("_p", pc)
    yc, pp = F.col(y), F.col("_p")
    wm = wmape_positive(yc, pp) if wmape == "positive" else wmape_all(yc, pp)
    aggs = [rmse(yc, pp).alias("RMSE"), wm.alias("WMAPE"), r2(yc, pp).alias("R2")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if rounded:
        out = out.withColumns({"RMSE": round_to("RMSE", 2), "WMAPE": round_to("WMAPE", 2),
                               "R2": round_to("R2", 4)})
    return out


def per_group_metrics(preds: DataFrame, by: str, y: str = "y", p: str = "p",
                      split_sizes: DataFrame | None = None, mape_empty: float | None = None) -> DataFrame:
    """Per-family RMSE, MAPE (y >= 5) and R2 of V3-V6, with sizes if given."""
    yc, pc = F.col(y), clip_zero(F.col(p))
    out = preds.groupBy(by).agg(rmse(yc, pc).alias("RMSE"), mape_min(yc, pc, empty=mape_empty).alias("MAPE"),
                                r2(yc, pc).alias("R2"))
    return out.join(split_sizes, by, "left") if split_sizes is not None else out


def macro_average(per_group: DataFrame, cols: list[str]) -> DataFrame:
    """Unweighted mean of per-family metrics (nulls skipped, as pandas)."""
    return per_group.agg(*[F.avg(c).alias(f"avg_{c}") for c in cols],
                         F.count(F.lit(1)).alias("n_groups"))


def naive_seasonal(test: DataFrame, fill_value: Column | float, lag: str = "lag_52",
                   out: str = "p") -> DataFrame:
    """M8: prediction = the value 52 weeks earlier; missing -> ``fill_value``
    (the train mean by default; the reference's test mean only for parity);
    clipped at 0 (N6)."""
    fv = fill_value if isinstance(fill_value, Column) else F.lit(float(fill_value))
    return test.withColumn(out, clip_zero(F.coalesce(F.col(lag), fv)))


def long_predictions(preds: DataFrame, keys: list[str], y: str, models: dict[str, str]) -> DataFrame:
    """Wide ``pred_<model>`` columns -> long (keys, y, model, p) rows."""
    stacked = preds.select(*keys, y, *[F.col(c).alias(m) for m, c in models.items()])
    return stacked.unpivot([*keys, y], list(models), "model", "p")


def wide_predictions(long: DataFrame, keys: list[str], y: str, models: list[str]) -> DataFrame:
    """Long (keys, y, model, p) -> one row per key with ``pred_<model>``
    columns.  The model list is given, so the pivot needs no distinct job and
    its width is fixed."""
    wide = long.groupBy(*keys, y).pivot("model", models).agg(F.first("p"))
    return wide.select(*keys, y, *[F.col(f"`{m}`").alias(f"pred_{m}") for m in models])


def compare_models(long: DataFrame, y: str = "y") -> DataFrame:
    """E9 + K7: one row per model (RMSE, WMAPE, R2), ranked by WMAPE."""
    return evaluate(long, y=y, p="p", by=["model"]).orderBy(F.asc("WMAPE"), F.asc("model"))


def best_model(ranking: DataFrame, exclude: list[str]) -> DataFrame:
    """K7: the best model by WMAPE, leaving out the listed ones."""
    return (ranking.filter(~F.col("model").isin(exclude))
            .agg(F.min_by("model", F.struct("WMAPE", "model")).alias("best_model")))


def chosen_model_metrics(long: DataFrame, by: str, exclude: list[str], y: str = "y") -> DataFrame:
    """K7 + E7: metrics per ``by`` of the best model of ``long(.., y, model, p)``.

    The choice is a one-row aggregate that the prediction rows meet as a
    broadcast, so ranking and metrics are one plan.  Only excluded models, or
    no rows, give no rows.
    """
    best = F.broadcast(best_model(evaluate(long, y=y, by=["model"]), exclude))
    chosen = long.join(best, long["model"] == best["best_model"])
    return evaluate(chosen, y=y, by=["best_model", by])


def change_against_baseline(metrics: DataFrame, baseline: float | None = MODEL_WMAPE,
                            col: str = "WMAPE") -> DataFrame:
    """Baseline minus new WMAPE (positive = better), rounded to 2; null without a baseline."""
    base = F.lit(baseline).cast("double")
    return metrics.withColumns({"baseline_WMAPE": base, "improvement_pp": round_to(base - F.col(col), 2)})
