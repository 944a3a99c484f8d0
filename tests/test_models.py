"""Models against closed forms, exact quantiles against NumPy,
scoring against the coefficients by hand, and the streaming scorer."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators import models as MD
from tillcast.operators.outliers import cap_series, exact_quantiles
from tillcast.operators.scoring import score, split_scored


def _ridge_closed_form(X, y, alpha, standardize):
    mu, ybar = X.mean(0), y.mean()
    s = X.std(0) if standardize else np.ones(X.shape[1])
    s = np.where(s < 10 * np.finfo(float).eps, 1.0, s)
    Z = (X - mu) / s
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - ybar))
    b = w / s
    return ybar - mu @ b, b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n, k = 400, 5
    X = rng.normal(size=(n, k)) * [1, 10, 100, 0.1, 1]
    X[:, 4] = 3.0                                   # a constant feature
    y = 2 + X @ [1.5, -0.2, 0.01, 4.0, 0.0] + rng.normal(size=n)
    fam = np.where(np.arange(n) % 3 == 0, "A", "B")
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(k)]).assign(y=y, Famille=fam)
    return pdf


@pytest.mark.parametrize("standardize", [True, False])
def test_global_ridge_closed_form(spark, data, standardize):
    feats = [c for c in data.columns if c.startswith("x")]
    m = MD.fit_ridge(spark.createDataFrame(data), feats, "y", 1.0, standardize)
    b0, b = _ridge_closed_form(data[feats].to_numpy(), data["y"].to_numpy(), 1.0, standardize)
    assert abs(m.intercept - b0) < 1e-6 * max(1, abs(b0))
    assert np.allclose(m.coef, b, rtol=1e-7, atol=1e-9)


def test_per_family_ridge_closed_form(spark, data):
    feats = [c for c in data.columns if c.startswith("x")]
    coefs = MD.fit_ridge_by_group(spark.createDataFrame(data), "Famille", feats, "y").collect()
    assert len(coefs) == 2
    for r in coefs:
        part = data[data.Famille == r["Famille"]]
        b0, b = _ridge_closed_form(part[feats].to_numpy(), part["y"].to_numpy(), 1.0, True)
        assert abs(r["intercept"] - b0) < 1e-6 * max(1, abs(b0))
        assert np.allclose([r[f"b_{f}"] for f in feats], b, rtol=1e-7, atol=1e-9)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.lognormal(3, 1, 5000), np.full(300, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, max_values=500, accuracy=100)   # forces narrowing rounds
    exp = np.quantile(vals, probs)
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


def test_exact_quantiles_several_columns(spark):
    from tillcast.operators.outliers import exact_quantiles_multi
    rng = np.random.default_rng(5)
    a = rng.normal(size=4000)
    b = rng.integers(0, 50, 4000).astype(float)
    b[::7] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = exact_quantiles_multi(df, {"a": [0.1, 0.5], "b": [0.25, 0.9]}, max_values=300, accuracy=50)
    assert np.allclose(got["a"], np.quantile(a, [0.1, 0.5]), atol=1e-12)
    assert np.allclose(got["b"], np.nanquantile(b, [0.25, 0.9]), atol=1e-12)


def test_exact_quantiles_between_two_heavy_values(spark):
    rng = np.random.default_rng(11)
    between = rng.uniform(0, 1, 500)
    vals = np.concatenate([np.zeros(20_000), np.ones(20_000), between])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    probs = [0.0, 0.2, 0.4938, 0.5, 0.5061, 0.8, 1.0]
    assert np.allclose(exact_quantiles(df, "v", probs, max_values=100, accuracy=1000), np.quantile(vals, probs), atol=1e-12)
    one = spark.createDataFrame(pd.DataFrame({"v": np.full(5000, 3.0)}))
    assert exact_quantiles(one, "v", [0.0, 0.5, 1.0], max_values=10) == [3.0, 3.0, 3.0]


def test_cap_series_p99(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(0, 10_000, 300).astype(float)
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame({"Date": days, "Quantite": q}))
    out = cap_series(df, "Quantite", 0.99).toPandas()
    t = pd.Series(q).quantile(0.99)
    assert np.allclose(out.sort_values("Date")["Quantite_capped"], np.where(q > t, t, q))


def test_best_round_patience():
    errs = [5, 4, 3, 3.5, 3.6, 3.7, 2.9, 4, 4, 4]
    assert MD.best_round(errs, 3) == 3     # stops before reaching the later 2.9
    assert MD.best_round(errs, 10) == 7


def test_growing_rounds_is_the_full_fit_under_the_patience_rule():
    rng = np.random.default_rng(4)
    for patience in (1, 5, 30):
        for _ in range(50):
            errs = (np.abs(np.arange(300) - rng.integers(0, 300)) + rng.normal(0, 20, 300)).tolist()
            fitted = []

            def fit(n):
                fitted.append(n)
                return errs[:n]
            assert MD.growing_rounds(fit, lambda m: m, 300, patience) == MD.best_round(errs, patience)
            assert sum(fitted) <= 2 * 2 * fitted[-1]


def test_trees_of_a_short_fit_begin_those_of_a_long_one(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.sin(x) * 10}))
    valid = MD.assemble(df, ["x"])
    short, long = (MD.fit_gbt(df, ["x"], "y", max_iter=n, step=0.3, depth=3)[0] for n in (4, 8))
    assert short.evaluateEachIteration(valid, "squared") == long.evaluateEachIteration(valid, "squared")[:4]


def test_gbt_of_many_small_partitions_runs_few_tasks(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 120)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.normal(size=120), "y": np.sin(x) * 10}))
    seen = MD.assemble(df, ["x", "z"])

    def fit(parts):
        held = df.repartition(parts, "x").persist()
        spark.sparkContext.setJobGroup(f"gbt-{parts}", "fit of small partitions")
        try:
            model, _ = MD.fit_gbt(held, ["x", "z"], "y", max_iter=3, depth=2)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            held.unpersist()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(f"gbt-{parts}") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
        return model.evaluateEachIteration(seen, "squared"), tasks

    (a, few), (b, many) = fit(20), fit(60)
    assert a == b                       # the drawn rows follow the rows, not the shuffle partitions
    assert many - few <= 5 * 40, (few, many)    # reading the frame, not the levels of the trees
    held = MD.assemble(df.repartition(3, "x"), ["x", "z"]).persist()
    assert MD._few_parts(held, ["x", "z", "y"]) is held


def test_gbt_beats_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 400)
    pdf = pd.DataFrame({"x": x, "z": rng.normal(size=400), "y": np.sin(x) * 10 + x})
    df = spark.createDataFrame(pdf)
    model, rounds = MD.fit_gbt(df, ["x", "z"], "y", max_iter=15, step=0.3, depth=3)
    pred = MD.predict_ml(model, df, ["x", "z"]).toPandas()
    rmse = np.sqrt(((pred.y - pred.prediction) ** 2).mean())
    assert rounds == 15 and rmse < pdf.y.std() / 2


def _requests(spark):
    rows = [("A", 2026, 53, 10.0, 9.0, 8.0, 7.0, 8.5, 8.0), ("A", 2025, 53, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("Z", 2024, 10, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("B", 2024, 27, 5.0, 4.0, 3.0, 2.0, 3.0, 2.5)]
    from tillcast.operators.scoring import REQUEST_SCHEMA
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def _model():
    from tillcast.constants import WEEKLY_FEATURES_15
    coef = [0.1 * (i + 1) for i in range(len(WEEKLY_FEATURES_15))]
    return MD.LinearModel(WEEKLY_FEATURES_15, -250.0, coef)


def test_score_by_hand(spark):
    codes = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "Famille string, Famille_encoded int")
    supported = spark.createDataFrame([("A",), ("B",)], "Famille string")
    out = score(_requests(spark), _model(), codes, supported, ["A"], ["B"]).collect()
    got = {(r["famille"], r["year"], r["week_of_year"]): r for r in out}
    assert got[("Z", 2024, 10)]["error"] == "Famille 'Z' not supported. Choose from: ['A', 'B']"
    assert got[("A", 2025, 53)]["error"].startswith("Invalid ISO week")
    m = _model()
    # 2026-W53 starts on Monday 2026-12-28: December, winter, no sales period
    x = [2026, 53, 12, 4, 0, 1, 0, 0, 0, 10.0, 9.0, 8.0, 7.0, 8.5, 8.0]
    exp = max(m.intercept + sum(c * v for c, v in zip(m.coef, x)), 0)
    assert got[("A", 2026, 53)]["predicted_quantity"] == round(exp, 2)
    # 2024-W27 starts on 2024-07-01: summer and sales period; B is a winter family
    x = [2024, 27, 7, 3, 1, 0, 1, 0, 1, 5.0, 4.0, 3.0, 2.0, 3.0, 2.5]
    exp = max(m.intercept + sum(c * v for c, v in zip(m.coef, x)), 0)
    assert abs(got[("B", 2024, 27)]["predicted_quantity"] - round(exp, 2)) < 1e-9


def test_stream_matches_batch(spark, tmp_path):
    from tillcast.streaming.scoring_stream import read_predictions, read_rejects, start_scoring
    codes = spark.createDataFrame([("A", 0), ("B", 1)], "Famille string, Famille_encoded int")
    supported = spark.createDataFrame([("A",), ("B",)], "Famille string")
    _requests(spark).write.parquet(str(tmp_path / "req"))
    q = start_scoring(spark, str(tmp_path / "req"), str(tmp_path / "out"), _model(), codes, supported,
                      name="test_stream", summer_families=["A"], winter_families=["B"])
    q.awaitTermination()
    streamed = read_predictions(spark, str(tmp_path / "out")).drop("batch_id")
    batch, rejects = split_scored(score(_requests(spark), _model(), codes, supported, ["A"], ["B"]))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert read_rejects(spark, str(tmp_path / "out")).count() == rejects.count() == 2


def test_save_load_linear(spark, tmp_path):
    m = _model()
    codes = spark.createDataFrame([("A", 0)], "Famille string, Famille_encoded int")
    MD.save_linear(m, spark, str(tmp_path / "m"), codes)
    m2, c2 = MD.load_linear(spark, str(tmp_path / "m"))
    assert m2.coef == m.coef and m2.intercept == m.intercept and c2.count() == 1


def test_score_null_request_fields(spark):
    from tillcast.operators.scoring import REQUEST_SCHEMA
    codes = spark.createDataFrame([("A", 0)], "Famille string, Famille_encoded int")
    supported = spark.createDataFrame([("A",)], "Famille string")
    req = spark.createDataFrame([(None, 2024, 10, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                                 ("A", None, 10, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                                 ("A", 2024, 10, 1.0, 1.0, None, 1.0, 1.0, 1.0)], REQUEST_SCHEMA)
    out = score(req, _model(), codes, supported).collect()
    assert all(r["error"] is not None and r["predicted_quantity"] is None for r in out)
    assert sorted(r["error"] for r in out) == ["Famille 'None' not supported. Choose from: ['A']",
                                               "Invalid ISO week: None-W10", "Missing value: lag_4"]


def test_gbt_stops_on_given_validation(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 300)
    pdf = pd.DataFrame({"x": x, "y": np.sin(x) * 10 + rng.normal(size=300)})
    train, valid = spark.createDataFrame(pdf[:200]), spark.createDataFrame(pdf[200:])
    model, rounds = MD.fit_gbt(train, ["x"], "y", max_iter=40, step=0.5, depth=4, patience=5, validation=valid)
    assert 1 <= rounds <= 40 and model.getNumTrees == rounds


def test_high_volume_train_only_means(spark):
    from tillcast.operators.select import high_volume
    rows = [("A", dt.date(2020, 1, 1), 10.0), ("A", dt.date(2025, 1, 1), 1000.0),
            ("B", dt.date(2020, 1, 1), 600.0), ("B", dt.date(2025, 1, 1), 600.0)]
    df = spark.createDataFrame(rows, "Famille string, week_start date, sum_Quantite double")
    leaky = {r[0] for r in high_volume(df, 500, []).select("Famille").distinct().collect()}
    clean = {r[0] for r in high_volume(df, 500, [], means_before=("week_start", "2024-01-01"))
             .select("Famille").distinct().collect()}
    assert leaky == {"A", "B"} and clean == {"B"}


def test_stream_several_micro_batches(spark, tmp_path):
    from tillcast.streaming.scoring_stream import read_predictions, read_rejects, start_scoring
    codes = spark.createDataFrame([("A", 0), ("B", 1)], "Famille string, Famille_encoded int")
    supported = spark.createDataFrame([("A",), ("B",)], "Famille string")
    req = _requests(spark)
    for i, part in enumerate(req.collect()):       # one file per request -> one micro-batch each
        spark.createDataFrame([part], req.schema).write.parquet(str(tmp_path / "req" / f"f{i}"))
    q = start_scoring(spark, str(tmp_path / "req" / "*"), str(tmp_path / "out"), _model(), codes, supported,
                      name="test_stream_many", max_files_per_trigger=1, summer_families=["A"],
                      winter_families=["B"])
    q.awaitTermination()
    out = read_predictions(spark, str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() >= 2
    batch, rejects = split_scored(score(req, _model(), codes, supported, ["A"], ["B"]))
    assert sorted(map(tuple, out.drop("batch_id").collect())) == sorted(map(tuple, batch.collect()))
    assert read_rejects(spark, str(tmp_path / "out")).count() == rejects.count()


def test_exact_quantiles_of_odd_columns(spark):
    from tillcast.operators.outliers import exact_quantiles_multi
    df = spark.createDataFrame([(1.0, None, float("nan"), 5), (float("inf"), None, 2.0, None), (-0.0, None, None, 7),
                                (0.0, None, 2.0, 5)], "a double, b double, c double, d int")
    got = exact_quantiles_multi(df, {"a": [0.0, 0.5, 1.0], "b": [0.5], "c": [0.1, 0.9], "d": [0.5, 0.75]})
    assert got == {"a": [0.0, 0.5, float("inf")], "b": [None], "c": [2.0, 2.0], "d": [5.0, 6.0]}
    assert exact_quantiles(df.limit(0), "a", [0.5]) == [None]


def test_exact_quantiles_count_every_value_when_the_sketch_misses(spark, monkeypatch):
    from tillcast.operators import outliers
    rng = np.random.default_rng(2)
    vals = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    monkeypatch.setattr(outliers, "_merged", lambda intervals: [(10.0, 11.0)])     # no rank lies there
    assert np.allclose(exact_quantiles(df, "v", [0.3, 0.8], max_values=200, accuracy=100),
                       np.quantile(vals, [0.3, 0.8]), atol=1e-12)


def test_exact_quantiles_count_only_the_values_near_the_ranks(spark, monkeypatch):
    from tillcast.operators import outliers
    seen = []
    real = outliers.materialize
    monkeypatch.setattr(outliers, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    df = spark.range(50_000).selectExpr("cast(id as double) as v", "id % 3 as w")
    got = outliers.exact_quantiles_multi(df, {"v": [0.25, 0.5], "w": [0.5]}, max_values=100, accuracy=1000)
    assert got == {"v": [12499.75, 24999.5], "w": [1.0]}
    assert len(seen) == 1 and seen[0].count() < 1_000      # of 50,003 distinct values
