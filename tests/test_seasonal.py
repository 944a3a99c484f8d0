"""Changepoint trend: optimality by NumPy, planted changes, guard and edge rows."""

import datetime as dt

import numpy as np
import pytest

from tillcast.operators import seasonal as SE
from tillcast.operators import select as S


def weeks(n, start=dt.date(2020, 1, 6)):
    return [start + dt.timedelta(days=7 * i) for i in range(n)]


def frame(spark, series):
    rows = [(f, d, float(y) if y is not None else None) for f, ys in series.items() for d, y in zip(weeks(len(ys)), ys)]
    return spark.createDataFrame(rows, "Famille string, week_start date, y double")


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    t = np.arange(160)
    bend = np.expm1(3 + 0.01 * t + np.where(t > 70, -0.03 * (t - 70), 0) + 0.3 * np.sin(2 * np.pi * t * 7 / 365.25) + rng.normal(0, .05, 160))
    line = np.expm1(2 + 0.005 * t + rng.normal(0, .05, 160))
    return {"bend": bend, "line": line, "short": line[:12], "zero": np.zeros(30), "one": [5.0]}


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(0)
    for trial in range(20):
        X = np.cumsum(rng.normal(size=(60, 25)), axis=1)              # strongly correlated columns
        if trial % 4 == 0:
            X = X[:15]                                                # fewer rows than columns
        y = X[:, 3] * 0.5 - X[:, 20] + rng.normal(size=len(X))
        H, q, lam = X.T @ X, X.T @ y, float(rng.choice([0.1, 5.0, 50.0, 1e6]))
        d = SE.lasso(H, q, lam)
        g = q - H @ d
        on = d != 0
        assert np.allclose(g[on], lam * np.sign(d[on]), rtol=1e-6, atol=1e-6)
        assert (np.abs(g[~on]) <= lam * (1 + 1e-6)).all()
        if lam == 1e6:
            assert not on.any()


def test_fit_is_optimal_and_finds_the_bend(spark, series):
    train = frame(spark, series)
    fitted = SE.fit_changepoint_trend(train, "Famille", "week_start", "y")
    rows = {r.Famille: r for r in fitted.collect()}
    assert set(rows) == set(series)
    for name in ("bend", "line"):
        x = np.stack([r._x for r in SE.with_terms(train.filter(f"Famille = '{name}'"), SE.spans(train, "Famille", "week_start", "y"),
                                                  "Famille", "week_start").orderBy("week_start").collect()])
        ly, b, lam = np.log1p(series[name]), np.array(rows[name].coef), rows[name].lam

        def loss(b):
            return ((ly - x @ b) ** 2).sum() / 2 + lam * np.abs(b[2:27]).sum() + (b[27:] ** 2).sum() / 2
        rng = np.random.default_rng(1)
        assert all(loss(b + rng.normal(0, s, len(b))) >= loss(b) for s in (1e-4, 1e-2, .3) for _ in range(50))
    bend, line = (np.array(rows[n].coef) for n in ("bend", "line"))
    def slope(b, t):
        return b[1] + sum(b[1 + j] for j in range(1, 26) if 0.8 * j / 25 <= t)
    assert slope(bend, 0.2) > 0 > slope(bend, 0.95)                   # turns down after week 70 of 160
    assert np.count_nonzero(line[2:27]) <= 6 and slope(line, 0.1) > 0 and slope(line, 1.0) > 0
    worst = SE.optimality(train, fitted, "Famille", "week_start", "y").groupBy("Famille").max("violation").collect()
    assert len(worst) == len(series) and all(r[1] < 1e-8 for r in worst)


def test_trend_goes_on_after_training(spark, series):
    train = frame(spark, {"bend": series["bend"][:140]})
    rows = spark.createDataFrame([("bend", d) for d in weeks(160)[140:]] + [("unknown", weeks(1)[0])], "Famille string, week_start date")
    got = SE.predict_changepoint_trend(rows, SE.fit_changepoint_trend(train, "Famille", "week_start", "y"), "Famille", "week_start").collect()
    got = [r.prediction for r in sorted(got, key=lambda r: r.week_start)]
    true = series["bend"][140:]
    assert len(got) == 20 and min(got) >= 0
    assert np.abs(got - true).sum() / true.sum() < 0.3                # the straight line would be far above


def test_many_batches_and_null_rows(spark, series):
    one = frame(spark, {"bend": series["bend"]})
    gaps = frame(spark, {"bend": series["bend"]}).unionByName(
        spark.createDataFrame([("bend", None, 5.0), ("bend", weeks(1)[0], None)], "Famille string, week_start date, y double")).repartition(13)
    a, b = (SE.fit_changepoint_trend(x, "Famille", "week_start", "y").first() for x in (one, gaps))
    assert a.n == b.n == 160 and np.allclose(a.coef, b.coef, atol=1e-7)


def test_guard_and_empty(spark, series):
    df = frame(spark, series)
    kept = S.guard_groups(df, "week_start", "2022-06-01", 10, 1)
    assert {r[0] for r in kept.select("Famille").distinct().collect()} == {"bend", "line"}
    none = SE.changepoint_trend(df.limit(0), df, "Famille", "week_start", "y")
    assert none.count() == 0 and none.columns == [*df.columns, "prediction"]
    assert SE.changepoint_trend(df, df.limit(0), "Famille", "week_start", "y").count() == 0
    one = SE.changepoint_trend(df, df.filter("Famille in ('one', 'zero')"), "Famille", "week_start", "y").collect()
    assert all(abs(r.prediction - r.y) < 1e-6 for r in one)
