"""Changepoint trend with yearly seasonality, per family.

``log1p`` of the target is a piecewise-linear trend plus yearly Fourier terms.
The trend's slope may change at 25 places spread evenly over the first 80 % of
a family's training period; the changes have a Laplace prior, so most are 0.
With b the terms of a row x, the fit minimises

    1/2 sum (ly - x b)^2 + lambda sum |changes| + alpha/2 sum fourier^2

with a free intercept and slope, and lambda = noise / (prior * top): noise is
the mean squared residual without changes, top the largest ``log1p`` target, so
that the prior is on changes of the target scaled to 1.

The data enter the fit through second moments only: a Gram matrix for each
Arrow batch and family, summed by Spark.  One row a family is solved by
coordinate descent, so no family's rows ever meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.constants import CHANGEPOINT_PRIOR, CHANGEPOINT_RANGE, CHANGEPOINTS, FOURIER_ORDER, RIDGE_ALPHA
from tillcast.functions.scalars import clip_zero

TERMS = (["intercept", "slope"] + [f"change_{j}" for j in range(1, CHANGEPOINTS + 1)]
         + [f"{f}_{k}" for k in range(1, FOURIER_ORDER + 1) for f in ("sin", "cos")])
_CHANGES = slice(2, 2 + CHANGEPOINTS)


def spans(train: DataFrame, key: str, date_col: str, target: str) -> DataFrame:
    """First and last training day and the largest ``log1p`` target of each family."""
    return train.groupBy(key).agg(F.min(F.to_date(date_col)).alias("_lo"), F.max(F.to_date(date_col)).alias("_hi"),
                                  F.max(F.log1p(clip_zero(F.col(target)))).alias("_top"))


def with_terms(df: DataFrame, span: DataFrame, key: str, date_col: str) -> DataFrame:
    """Rows with their terms ``_x`` (in the order of TERMS); families without a span are left out.

    Time runs from 0 to 1 over the training period, and further after it.  In a
    family that trained on one day only it stays 0.
    """
    day = F.datediff(F.to_date(date_col), F.col("_lo")).cast("double")
    width = F.datediff("_hi", "_lo")
    t = F.when(width > 0, day / width).otherwise(0.0)
    days = F.datediff(F.to_date(date_col), F.lit("1970-01-01").cast("date")).cast("double")
    terms = [F.lit(1.0), t] + [F.greatest(t - F.lit(CHANGEPOINT_RANGE * j / CHANGEPOINTS), F.lit(0.0))
                               for j in range(1, CHANGEPOINTS + 1)]
    for k in range(1, FOURIER_ORDER + 1):
        angle = days * (2 * math.pi * k / 365.25)
        terms += [F.sin(angle), F.cos(angle)]
    return df.join(span, key).withColumn("_x", F.array(*terms))


def moments(rows: DataFrame, key: str, y: str) -> DataFrame:
    """(key, n, g): the number of rows and the sums of products of all terms and ``y`` (last), row by row.

    Each Arrow batch gives one matrix a family; the sums over batches are an
    aggregate by (family, place) with partial sums in every task.
    """
    m = len(TERMS) + 1
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        for pdf in batches:
            out = []
            for fam, part in pdf.groupby(key, sort=False, dropna=False):
                z = np.column_stack([np.stack(part["_x"].to_numpy()), part[y].to_numpy(float)])
                out.append((None if pd.isna(fam) else fam, len(part), (z.T @ z).ravel().tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "g"])

    parts = rows.select(key, "_x", y).mapInPandas(work, f"`{key}` {kind}, n long, g array<double>")
    cells = parts.select(key, "n", F.posexplode("g").alias("at", "v")).groupBy(key, "at").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"))
    # a fixed number of cells a family
    return cells.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "v"))).alias("g")).select(
        key, "n", F.expr(f"transform(slice(g, 1, {m * m}), c -> c.v)").alias("g"))


def lasso(H: np.ndarray, q: np.ndarray, lam: float, sweeps: int = 200, rounds: int = 200) -> np.ndarray:
    """Minimum of ``d'Hd/2 - q'd + lam |d|`` by coordinate descent, finished exactly.

    After each bundle of sweeps the values that are not 0 are solved for with
    their signs held; the result stands if the signs stay and no other
    coordinate wants to move.
    """
    d = np.zeros(len(q))
    live = [j for j in range(len(q)) if H[j, j] > 1e-12]
    for _ in range(rounds):
        for _ in range(sweeps):
            for j in live:
                r = q[j] - H[j] @ d + H[j, j] * d[j]
                d[j] = np.sign(r) * max(abs(r) - lam, 0.0) / H[j, j]
        on = np.flatnonzero(d)
        exact = np.zeros(len(q))
        if len(on):
            exact[on] = np.linalg.lstsq(H[np.ix_(on, on)], q[on] - lam * np.sign(d[on]), rcond=None)[0]
        slack = np.abs(q - H @ exact)
        slack[on] = 0.0
        if (np.sign(exact[on]) == np.sign(d[on])).all() and slack[live].max(initial=0.0) <= lam * (1 + 1e-9) + 1e-12:
            return exact
    return d


def solve(g: np.ndarray, n: int, top: float, prior: float = CHANGEPOINT_PRIOR,
          alpha: float = RIDGE_ALPHA) -> tuple[np.ndarray, float]:
    """Coefficients (in the order of TERMS) and lambda from the moments of one family.

    The free terms are eliminated, so the descent runs over the changes alone.
    """
    k = len(TERMS)
    G = np.asarray(g, float).reshape(k + 1, k + 1)
    A, c, yy = G[:k, :k], G[:k, k], G[k, k]
    change = np.zeros(k, bool)
    change[_CHANGES] = True
    h, u = np.flatnonzero(change), np.flatnonzero(~change)
    ridge = np.diag(np.where(u < 2, 0.0, alpha))
    inverse = np.linalg.pinv(A[np.ix_(u, u)] + ridge, hermitian=True)
    plain = inverse @ c[u]
    noise = max((yy - 2 * plain @ c[u] + plain @ A[np.ix_(u, u)] @ plain) / n, 1e-8)
    lam = noise / (prior * top) if top > 0 else noise / prior
    across = A[np.ix_(h, u)] @ inverse
    d = lasso(A[np.ix_(h, h)] - across @ A[np.ix_(u, h)], c[h] - across @ c[u], lam)
    b = np.zeros(k)
    b[h] = d
    b[u] = inverse @ (c[u] - A[np.ix_(u, h)] @ d)
    return b, lam


def fit_changepoint_trend(train: DataFrame, key: str, date_col: str, target: str,
                          prior: float = CHANGEPOINT_PRIOR, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """One row a family: (key, _lo, _hi, _top, n, coef array<double>, lam).

    Rows without a date or target are left out; targets below 0 count as 0.
    """
    rows = train.filter(F.col(date_col).isNotNull() & F.col(target).isNotNull())
    span = spans(rows, key, date_col, target)
    stats = moments(with_terms(rows, span, key, date_col).withColumn("_ly", F.log1p(clip_zero(F.col(target)))), key, "_ly")
    stats = stats.join(span, key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name not in ("g",))

    def work(batches):
        for pdf in batches:
            fits = [solve(g, n, top, prior, alpha) for g, n, top in zip(pdf["g"], pdf["n"], pdf["_top"])]
            yield pdf.drop(columns="g").assign(coef=[b.tolist() for b, _ in fits], lam=[float(lam) for _, lam in fits])

    out = [f.name for f in stats.schema.fields if f.name != "g"]
    return stats.select(*out, "g").mapInPandas(work, f"{kinds}, coef array<double>, lam double")


def _level() -> Column:
    return F.expr("aggregate(zip_with(_x, coef, (u, v) -> u * v), 0D, (s, v) -> s + v)")


def predict_changepoint_trend(df: DataFrame, fitted: DataFrame, key: str, date_col: str, out: str = "prediction") -> DataFrame:
    """``df`` with predictions (never below 0); the last slope goes on.  Families without a fit are dropped."""
    rows = with_terms(df, fitted, key, date_col)
    return rows.withColumn(out, clip_zero(F.expm1(_level()))).select(*df.columns, out)


def changepoint_trend(train: DataFrame, test: DataFrame, key: str, date_col: str, target: str,
                      out: str = "prediction") -> DataFrame:
    """M9: fit on ``train``, predict ``test``."""
    return predict_changepoint_trend(test, fit_changepoint_trend(train, key, date_col, target), key, date_col, out)


def optimality(train: DataFrame, fitted: DataFrame, key: str, date_col: str, target: str,
               alpha: float = RIDGE_ALPHA) -> DataFrame:
    """(key, term, at_day, n, violation): how far each term is from its optimality condition, a row.

    From residuals of the rows themselves, not from the moments.  Free terms:
    the sum of residual times term is 0.  Fourier: it is alpha times the value.
    Changes: it is lambda times the sign, or at most lambda where the change is
    0.  ``at_day`` is a change's place in days after the family's first day.
    """
    rows = train.filter(F.col(date_col).isNotNull() & F.col(target).isNotNull())
    fits = fitted.select(key, "_lo", "_hi", "coef", "lam")
    x = (with_terms(rows, fits, key, date_col).withColumn("_r", F.log1p(clip_zero(F.col(target))) - _level())
         .select(key, "_lo", "_hi", "_r", "lam", F.posexplode(F.arrays_zip("_x", "coef")).alias("j", "c")))
    sums = x.groupBy(key, "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_r") * F.col("c._x")).alias("s"), F.first("c.coef").alias("b"),
        F.first("lam").alias("lam"), F.first(F.datediff("_hi", "_lo")).alias("width"))
    change = F.col("j").between(_CHANGES.start, _CHANGES.stop - 1)
    off = (F.when(~change, F.abs(F.col("s") - F.when(F.col("j") < 2, 0.0).otherwise(alpha * F.col("b"))))
           .when(F.col("b") == 0, F.greatest(F.abs("s") - F.col("lam"), F.lit(0.0)))
           .otherwise(F.abs(F.col("s") - F.signum("b") * F.col("lam"))))
    names = F.array(*[F.lit(t) for t in TERMS])
    place = F.when(change, CHANGEPOINT_RANGE * (F.col("j") - 1) * F.col("width") / CHANGEPOINTS)
    return sums.select(key, F.get(names, F.col("j")).alias("term"), place.alias("at_day"), "n", (off / F.col("n")).alias("violation"))
