"""Models (M1-M12, M15).

Ridge (M1-M4) is fitted from sufficient statistics: one aggregate gives the
row count, the means and the population covariances of the features and the
target, which is all scikit-learn's standardised ridge needs.  The aggregate
is computed partially in every task, so the fit is one pass over the data and
the result has a size fixed by the feature count (k + k(k+1)/2 + k values).
Per family it is the same aggregate grouped by family (one row per family),
solved in ``mapInPandas``: no training row leaves its task.

The tree models (M5-M7) are spark.ml estimators, distributed by Spark; the
per-family variant (M6) fits one distributed model per family of a list whose
size is the number of families.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.constants import COLSAMPLE, GBT_SEED, RIDGE_ALPHA, SUBSAMPLE
from tillcast.sources.versions import path_exists

# scikit-learn treats a scale below 10 * machine epsilon as 0 and uses 1
_SCALE_EPS = 10 * np.finfo(np.float64).eps


# ------------------------------------------------------------------ M1-M4 ridge

@dataclass
class LinearModel:
    """``y = intercept + sum(coef[i] * x[i])`` on raw features, plus the
    scaler statistics it was fitted with (for M12 and reporting)."""
    features: list[str]
    intercept: float
    coef: list[float]
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    alpha: float = RIDGE_ALPHA
    standardize: bool = True
    n: int = 0

    def predict_col(self) -> Column:
        expr = F.lit(float(self.intercept))
        for f, b in zip(self.features, self.coef):
            expr = expr + F.lit(float(b)) * F.col(f).cast("double")
        return expr


def moment_aggs(features: list[str], target: str) -> list[Column]:
    """Sufficient statistics of a linear fit as aggregate columns."""
    xs = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    k = len(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("ybar")]
    aggs += [F.avg(x).alias(f"mu_{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"c_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.covar_pop(xs[i], y).alias(f"cy_{i}") for i in range(k)]
    return aggs


def solve_ridge(stats, k: int, alpha: float, standardize: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Closed-form ridge with an unpenalised intercept from the statistics.

    Standardised (scikit-learn ``StandardScaler`` + ``Ridge``): with C the
    population covariance and s its root diagonal, w solves
    (n C/ss' + alpha I) w = n c/s; raw coefficients are w / s.
    """
    n = float(stats["n"])
    mu = np.array([stats[f"mu_{i}"] for i in range(k)], dtype=float)
    C = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            C[i, j] = C[j, i] = stats[f"c_{i}_{j}"]
    cy = np.array([stats[f"cy_{i}"] for i in range(k)], dtype=float)
    if standardize:
        s = np.sqrt(np.clip(np.diag(C), 0, None))
        s = np.where(s < _SCALE_EPS, 1.0, s)
        w = np.linalg.solve(n * C / np.outer(s, s) + alpha * np.eye(k), n * cy / s)
        b = w / s
    else:
        s = np.ones(k)
        b = np.linalg.solve(n * C + alpha * np.eye(k), n * cy)
    b0 = float(stats["ybar"]) - float(mu @ b)
    return b0, b, mu, s


def _complete(df: DataFrame, features: list[str], target: str) -> DataFrame:
    cond = F.col(target).isNotNull()
    for f in features:
        cond = cond & F.col(f).isNotNull()
    return df.filter(cond)


def fit_ridge(train: DataFrame, features: list[str], target: str, alpha: float = RIDGE_ALPHA,
              standardize: bool = True) -> LinearModel:
    """M2 (standardised) / M3 (raw): one global ridge.  The only row brought
    back is the one-row statistics aggregate."""
    stats = _complete(train, features, target).agg(*moment_aggs(features, target)).first().asDict()
    if not stats["n"]:
        raise ValueError("no training rows")
    b0, b, mu, s = solve_ridge(stats, len(features), alpha, standardize)
    return LinearModel(features, b0, b.tolist(), mu.tolist(), s.tolist(), alpha, standardize, int(stats["n"]))


def scaler_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """M1: mean and population std of each feature (one row per feature)."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"),
                     F.when(F.col(f"s_{f}") < _SCALE_EPS, 1.0).otherwise(F.col(f"s_{f}")).alias("scale"))
            for f in features]
    return train.agg(*aggs).select(F.inline(F.array(*rows)))


def fit_ridge_by_group(train: DataFrame, key: str, features: list[str], target: str,
                       alpha: float = RIDGE_ALPHA, standardize: bool = True) -> DataFrame:
    """M4: one ridge per group.  Returns one row per group:
    (key, n, intercept, b_<feature>...)."""
    k = len(features)
    stats = _complete(train, features, target).groupBy(key).agg(*moment_aggs(features, target))
    key_type = train.schema[key].dataType
    out_schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType())]
        + [T.StructField(f"b_{f}", T.DoubleType()) for f in features])

    def solve_partition(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                b0, b, _, _ = solve_ridge(rec, k, alpha, standardize)
                rows.append([rec[key], int(rec["n"]), b0, *b.tolist()])
            yield pd.DataFrame(rows, columns=out_schema.fieldNames())

    return stats.mapInPandas(solve_partition, out_schema)


def predict_by_group(df: DataFrame, coefs: DataFrame, key: str, features: list[str],
                     out: str = "prediction") -> DataFrame:
    """Apply per-group coefficients: a join on the group key (one row per
    group on the right) and a linear expression.  Groups without a model
    are dropped (inner join), as the reference skips them."""
    expr = F.col("intercept")
    for f in features:
        expr = expr + F.col(f"b_{f}") * F.col(f).cast("double")
    return df.join(coefs, on=key, how="inner").withColumn(out, expr).drop(
        "n", "intercept", *[f"b_{f}" for f in features])


def ridge_gradient(train: DataFrame, features: list[str], target: str, prediction: str,
                   coef: dict[str, Column], alpha: float = RIDGE_ALPHA, by: list[str] | None = None) -> DataFrame:
    """Optimality of a standardised ridge on its train rows: per term, the
    gradient of its loss relative to ``n`` times the target's deviation (0 at
    the optimum, whatever the features' scale).  One aggregate; one row per
    term (and group): (by, term, n, gradient).  ``intercept`` is the mean residual.
    """
    y = F.col(target).cast("double")
    resid = y - F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(resid).alias("_r"), F.stddev_pop(y).alias("_sy")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.covar_pop(x, resid).alias(f"_c{i}"), F.stddev_pop(x).alias(f"_s{i}"), F.first(coef[f]).alias(f"_b{i}")]
    rows = [F.struct(F.lit("intercept").alias("term"), (F.col("_r") / F.col("_sy")).alias("gradient"))]
    for i, f in enumerate(features):
        s = F.when(F.col(f"_s{i}") < _SCALE_EPS, 1.0).otherwise(F.col(f"_s{i}"))
        g = (F.col("n") * F.col(f"_c{i}") - alpha * s * s * F.col(f"_b{i}")) / (F.col("n") * s * F.col("_sy"))
        rows.append(F.struct(F.lit(f).alias("term"), g.alias("gradient")))
    by = by or []
    return (_complete(train, features, target).groupBy(*by).agg(*aggs)
            .select(*by, "n", F.inline(F.array(*rows)))
            .select(*by, "term", "n", F.abs("gradient").alias("gradient")))


# ------------------------------------------------------------------ M5-M7 trees

FEWEST_PARTS, ROWS_A_PART = 8, 50_000       # partitions a GBT fit may always have; rows of one where there are more


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Ordered feature list -> vector column (nulls raise, as NumPy would)."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(
        df.withColumns({f: F.col(f).cast("double") for f in features}))


def best_round(errors: list[float], patience: int) -> int:
    """Early stopping: the round (1-based) with the lowest validation error
    among rounds seen before ``patience`` rounds pass without improvement."""
    best, best_i = float("inf"), 0
    for i, e in enumerate(errors):
        if e < best:
            best, best_i = e, i
        elif i - best_i >= patience:
            break
    return best_i + 1


def growing_rounds(fit, errors_of, max_iter: int, patience: int, first: int = 64) -> int:
    """Best round under the patience rule without fitting all ``max_iter`` rounds.

    ``fit(n)`` fits n rounds and ``errors_of(model)`` gives the validation error
    after each.  For one seed the trees of n rounds begin those of 2n, so fits of
    64, 128, 256, ... rounds see the same errors as the full fit; the first in
    which the rule fires has the answer, at no more than about twice its work.
    """
    n = min(first, max_iter)
    while True:
        errors = list(errors_of(fit(n)))
        rounds = best_round(errors, patience)
        if n == max_iter or n - rounds >= patience:
            return rounds
        n = min(2 * n, max_iter)


def fit_gbt(train: DataFrame, features: list[str], target: str, max_iter: int = 100,
            step: float = 0.05, depth: int = 5, seed: int = GBT_SEED, patience: int | None = None,
            date_col: str | None = None, valid_fraction: float = 0.2,
            validation: DataFrame | None = None):
    """M5: gradient-boosted trees (squared loss), subsample 0.8, 0.8 of the
    features per split, seed 42.

    With ``patience``, the last ``valid_fraction`` of the training period is
    held out (never the test set), growing fits of up to ``max_iter`` rounds
    give the best round under the patience rule (see :func:`growing_rounds`),
    and the model is refitted on the whole training set with that many rounds.

    ``validation`` gives the stopping set explicitly; passing the test rows
    reproduces the reference's early stopping on the test set (a leak, for
    parity runs only).  Returns (model, rounds).
    """
    # the fit, the validation pass and the refit all read the same frame
    held = assemble(train, features).persist()
    data = _few_parts(held, [*features, target])
    try:
        return _fit_gbt(data, features, target, max_iter, step, depth, seed, patience, date_col, valid_fraction, validation)
    finally:
        data.unpersist()
        held.unpersist()


def _few_parts(data: DataFrame, columns: list[str]) -> DataFrame:
    """``data`` in no more partitions than a fit needs: a level of a tree starts two tasks for each, empty or not.

    Up to FEWEST_PARTS partitions stay as they are.  Beyond, rows are dealt and
    sorted by their values, so that the subsample, which spark.ml draws by
    partition, depends on the rows and no longer on the shuffle partitions.
    """
    parts = data.select("features").rdd.getNumPartitions()
    if parts <= FEWEST_PARTS:
        return data
    few = max(FEWEST_PARTS, -(-data.count() // ROWS_A_PART))
    if few >= parts:
        return data
    return data.repartition(few, *columns).sortWithinPartitions(*columns).persist()


def _fit_gbt(data, features, target, max_iter, step, depth, seed, patience, date_col, valid_fraction, validation):
    def make(n):
        return GBTRegressor(featuresCol="features", labelCol=target, maxIter=n, stepSize=step, maxDepth=depth,
                            subsamplingRate=SUBSAMPLE, featureSubsetStrategy=str(COLSAMPLE), seed=seed,
                            lossType="squared")
    rounds = max_iter
    if patience is not None and validation is not None:
        held = assemble(validation, features)
        rounds = growing_rounds(lambda n: make(n).fit(data), lambda m: m.evaluateEachIteration(held, "squared"),
                                max_iter, patience)
    elif patience is not None and date_col is not None:
        cut = data.agg(F.percentile_approx(F.col(date_col).cast("timestamp").cast("long"),
                                           F.lit(1 - valid_fraction))).first()[0]
        ts = F.col(date_col).cast("timestamp").cast("long")
        fit_part, valid = data.filter(ts < cut), data.filter(ts >= cut)
        if not fit_part.take(1) or not valid.take(1):
            raise ValueError("early stopping needs rows on both sides of the validation date")
        rounds = growing_rounds(lambda n: make(n).fit(fit_part), lambda m: m.evaluateEachIteration(valid, "squared"),
                                max_iter, patience)
    return make(rounds).fit(data), rounds


def fit_random_forest(train: DataFrame, features: list[str], target: str, trees: int = 300,
                      depth: int = 8, seed: int = GBT_SEED):
    """M7: random forest, all features considered at every split."""
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth,
                               featureSubsetStrategy="all", seed=seed)
    return rf.fit(assemble(train, features))


def predict_ml(model, df: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
    return model.setPredictionCol(out).transform(assemble(df, features)).drop("features")


def fit_gbt_by_group(train: DataFrame, test: DataFrame, key: str, features: list[str], target: str,
                     families: list[str], parallelism: int = 4, **gbt_args) -> DataFrame:
    """M6: one distributed GBT fit per family of ``families`` (a list with
    one entry per family); returns the test rows with predictions.

    Fits are submitted from ``parallelism`` driver threads, so the small
    per-family jobs share the cluster instead of running one after another.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(fam):
        tr, te = train.filter(F.col(key) == fam), test.filter(F.col(key) == fam)
        model, _ = fit_gbt(tr, features, target, **gbt_args)
        return predict_ml(model, te, features)

    if not families:
        return test.limit(0).withColumn("prediction", F.lit(None).cast("double"))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        preds = list(pool.map(one, families))
    out = preds[0]
    for pred in preds[1:]:
        out = out.unionByName(pred)
    return out


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) sorted descending; size = feature count."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(features, [float(v) for v in imp]), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# ------------------------------------------------------------------ M12 save / load

def save_linear(model: LinearModel, spark, path: str, codes: DataFrame | None = None) -> None:
    """Coefficients (one row) and the category code table as Parquet."""
    row = [(model.features, float(model.intercept), [float(c) for c in model.coef],
            [float(m) for m in model.mean], [float(s) for s in model.scale], float(model.alpha),
            bool(model.standardize), int(model.n))]
    schema = ("features array<string>, intercept double, coef array<double>, mean array<double>, "
              "scale array<double>, alpha double, standardize boolean, n bigint")
    spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/model")
    if codes is not None:
        codes.write.mode("overwrite").parquet(f"{path}/codes")


def load_linear(spark, path: str) -> tuple[LinearModel, DataFrame | None]:
    r = spark.read.parquet(f"{path}/model").first()
    model = LinearModel(list(r["features"]), r["intercept"], list(r["coef"]), list(r["mean"]),
                        list(r["scale"]), r["alpha"], r["standardize"], r["n"])
    codes = spark.read.parquet(f"{path}/codes") if path_exists(spark, f"{path}/codes") else None
    return model, codes
