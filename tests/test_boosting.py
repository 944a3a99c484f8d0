"""Grouped histogram boosting against a NumPy twin; best-first shapes; edge rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators import boosting as B

FEATS = ["a", "b", "c"]


def make(n=240, seed=0, families=("x", "y")):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"Famille": [families[i % len(families)] for i in range(n)], "a": rng.integers(0, 50, n).astype(float),
                        "b": rng.normal(size=n).round(3), "c": rng.integers(0, 3, n).astype(float)})
    pdf["y"] = np.where(pdf.a > 20, 10.0, 2.0) + pdf.b * np.where(pdf.Famille == "x", 3, -3) + rng.normal(0, .2, n).round(3)
    pdf["role"] = np.where(np.arange(n) % 5 == 4, "test", np.where(np.arange(n) % 5 == 3, "valid", "fit"))
    return pdf


def cuts_of(x, bins=32):
    x = np.sort(x)
    return sorted({x[int(np.ceil(k / bins * len(x))) - 1] for k in range(1, bins)})


def twin_tree(bins, res, depth, l2, min_rows, chosen):
    """Exhaustive level-wise tree: {node: (f, b, gain, sl, nl, sr, nr)}."""
    out, todo = {}, [(1, np.arange(len(res)))]
    while todo:
        v, rows = todo.pop(0)
        if v >= 2 ** depth:
            continue
        best = None
        s, n = res[rows].sum(), len(rows)
        for f in chosen:
            for b in range(int(bins[rows, f].max()) if n else 0):
                left = rows[bins[rows, f] <= b]
                sl, nl = res[left].sum(), len(left)
                if nl < min_rows or n - nl < min_rows or not (bins[rows, f] == b).any():
                    continue
                gain = 0.5 * (sl * sl / (nl + l2) + (s - sl) ** 2 / (n - nl + l2) - s * s / (n + l2))
                if gain > 1e-9 and (best is None or gain > best[2] + 1e-9):
                    best = (f, b, gain, sl, nl, s - sl, n - nl)
        if best:
            out[v] = best
            left = bins[rows, best[0]] <= best[1]
            todo += [(2 * v, rows[left]), (2 * v + 1, rows[~left])]
    return out


def value(tree, row, step, l2):
    v = 1
    while v in tree:
        v = 2 * v + int(row[tree[v][0]] > tree[v][1])
    if v == 1:
        return 0.0
    _, _, _, sl, nl, sr, nr = tree[v // 2]
    return step * (sl / (nl + l2) if v % 2 == 0 else sr / (nr + l2))


def twin(pdf, rounds, step, depth, patience, chosen_of, leaves=None, l2=1.0, min_rows=1):
    out = {}
    for fam, part in pdf.groupby("Famille"):
        fit = (part.role == "fit").to_numpy()
        valid = (part.role == "valid").to_numpy()
        y = part.y.to_numpy()
        bins = np.stack([np.searchsorted(cuts_of(part[f].to_numpy()[fit]), part[f].to_numpy(), side="left") for f in FEATS], axis=1)
        pred = np.full(len(part), y[fit].mean())
        best, best_err, best_round, trees = pred, None, 0, []
        for r in range(1, rounds + 1):
            tree = twin_tree(bins[fit], (y - pred)[fit], depth, l2, min_rows, chosen_of[r])
            if leaves:
                kept = B.best_first({v: s[2] for v, s in tree.items()}, leaves)
                tree = {v: s for v, s in tree.items() if v in kept}
            trees.append(tree)
            pred = pred + np.array([value(tree, row, step, l2) for row in bins])
            err = ((y - pred)[valid] ** 2).mean() if valid.any() else None
            if patience is None or err is None or best_err is None or err < best_err:
                best, best_err, best_round = pred, err, r
            if patience is not None and r - best_round >= patience:
                break
        out[fam] = (dict(zip(part.index, best)), best_round, trees)
    return out


@pytest.mark.parametrize("leaves,colsample", [(None, 1.0), (5, 1.0), (None, 0.67)])
def test_boosting_is_the_twin(spark, leaves, colsample):
    pdf = make()
    df = spark.createDataFrame(pdf.reset_index(names="k"))
    m = B.fit_boosting(df, "Famille", FEATS, "y", rounds=3, step=0.3, depth=3, patience=2, subsample=1.0, colsample=colsample, leaves=leaves)
    chosen_of = {r._round: r.c for r in spark.range(1, 4).selectExpr("cast(id as int) as _round")
                 .select("_round", B._chosen(3, max(1, int(colsample * 3)), 42).alias("c")).collect()}
    assert colsample == 1.0 or len({tuple(c) for c in chosen_of.values()}) > 1
    want = twin(pdf, 3, 0.3, 3, 2, chosen_of, leaves)
    got = {r.k: r.prediction for r in m.predictions.collect()}
    assert len(got) == len(pdf)
    assert all(abs(got[k] - p) < 1e-9 for preds, _, _ in want.values() for k, p in preds.items())
    assert {r.Famille: r.best_round for r in m.rounds.collect()} == {f: r for f, (_, r, _) in want.items()}
    for r in m.trees.collect():
        tree = want[r.Famille][2][r.round - 1]
        assert {v: (s.f, s.b, s.nl, s.nr) for v, s in r.splits.items()} == {v: (s[0], s[1], s[4], s[6]) for v, s in tree.items()}
        assert leaves is None or len(r.splits) <= leaves - 1
    again = {r.k: r.prediction for r in B.predict_boosting(m, df, "Famille", FEATS).collect()}
    assert all(abs(again[k] - got[k]) < 1e-9 for k in got)
    shares = {}
    for r in B.split_importance(m, "Famille", FEATS).collect():
        shares[r.Famille] = shares.get(r.Famille, 0) + r.gain
    assert all(abs(v - 1) < 1e-9 for v in shares.values()) and set(shares) == {"x", "y"}


def test_best_first_takes_the_largest_gain_next():
    gains = {1: 5.0, 2: 1.0, 3: 2.0, 4: 9.0, 5: 0.5, 6: 1.5, 7: 0.1}
    assert [len(B.best_first(gains, k)) for k in (1, 2, 9)] == [0, 1, 7]
    assert B.best_first(gains, 3) == {1, 3}                     # 4 is hidden behind 2
    assert B.best_first(gains, 5) == {1, 3, 6, 2} and B.best_first(gains, 6) == {1, 3, 6, 2, 4}
    assert B.best_first({2: 1.0}, 4) == set()


def test_sampling_learns_and_stops_by_family(spark):
    pdf = make(600, 3, ("x", "y", "z"))
    pdf.loc[pdf.Famille == "z", "y"] = np.random.default_rng(1).normal(size=200)       # nothing to learn
    m = B.fit_boosting(spark.createDataFrame(pdf), "Famille", FEATS, "y", rounds=11, step=0.5, depth=2, patience=4)
    rounds = {r.Famille: r.best_round for r in m.rounds.collect()}
    err = {r[0]: (r[1], r[2]) for r in m.predictions.filter("role = 'test'").groupBy("Famille").agg(
        F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y")).collect()}
    assert rounds["z"] < rounds["x"] and all(err[f][0] < 0.3 * err[f][1] for f in "xy")


def test_edge_rows(spark):
    pdf = make(60)
    odd = pd.DataFrame({"Famille": ["one", "flat", "flat", "flat", "late", "x", "x"], "a": [1.0, 1, 2, 3, 1, None, 2], "b": 0.0, "c": 0.0,
                        "y": [4.0, 7, 7, 7, 1, 5, None], "role": ["fit", "fit", "fit", "test", "test", "fit", "fit"]})
    df = spark.createDataFrame(pd.concat([pdf, odd]))
    m = B.fit_boosting(df, "Famille", FEATS, "y", rounds=3, depth=2, patience=2)
    got = m.predictions.toPandas()
    assert len(got) == 66 and "late" not in set(got.Famille)    # no fit rows: no model
    assert got[got.Famille == "one"].prediction.tolist() == [4.0] and set(got[got.Famille == "flat"].prediction) == {7.0}
    assert got.prediction.notna().all()
    none = B.fit_boosting(df.limit(0), "Famille", FEATS, "y", rounds=2, depth=2, patience=1)
    assert none.predictions.count() == 0 and none.trees.count() == 0


def test_roles_by_date(spark):
    df = spark.sql("select if(id % 3 = 0, 'p', 'q') as Famille, date_add(date'2020-01-01', cast(id as int)) as Date from range(100)")
    got = B.hold_out_last(df.union(spark.sql("select 'p', cast(null as date)")), "Famille", "Date", "2020-03-01").toPandas()
    assert len(got) == 100 and set(got[got.Date >= pd.Timestamp("2020-03-01").date()].role) == {"test"}
    for _, part in got[got.role != "test"].groupby("Famille"):
        valid = part[part.role == "valid"]
        assert 0.1 <= len(valid) / len(part) <= 0.25 and valid.Date.min() > part[part.role == "fit"].Date.max()


def test_a_round_is_one_job_a_level(spark):
    df = spark.createDataFrame(make(300, 5))
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"boosting-{rounds}", "rounds of boosting")
        try:
            B.fit_boosting(df, "Famille", FEATS, "y", rounds=rounds, depth=3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{rounds}"))
    jobs(1)
    assert jobs(7) - jobs(3) <= 4 * 3


def test_rows_in_many_tasks_give_the_same_trees(spark, monkeypatch):
    df = spark.createDataFrame(make(400, 7).reset_index(names="k"))
    fits = []
    for rows in (50_000, 60):
        monkeypatch.setattr(B, "ROWS_A_TASK", rows)
        monkeypatch.setattr(B, "KEEP_EVERY", 2)
        m = B.fit_boosting(df, "Famille", FEATS, "y", rounds=6, step=0.3, depth=3, patience=5)
        fits.append(({r.k: round(r.prediction, 9) for r in m.predictions.collect()}, sorted(map(tuple, m.rounds.select("Famille", "best_round").collect())),
                     {(r.Famille, r.round, v, s.f, s.b) for r in m.trees.collect() for v, s in r.splits.items()}))
    assert fits[0] == fits[1] and len(fits[0][0]) == 400


def test_a_level_is_one_wave_of_tasks(spark, monkeypatch):
    df = spark.createDataFrame(make(400, 9).reset_index(names="k"))
    cores, tracker = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()

    def fit(group, rows, most):
        monkeypatch.setattr(B, "ROWS_A_TASK", rows)
        monkeypatch.setattr(B, "MOST_ROWS", most)
        spark.sparkContext.setJobGroup(group, "tasks of boosting")
        try:
            m = B.fit_boosting(df, "Famille", FEATS, "y", rounds=2, step=0.3, depth=3, patience=5)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info and "reduceByKey" in info.name]
        return max(tasks), {r.k: round(r.prediction, 9) for r in m.predictions.collect()}

    one, alone = fit("one-task", 400, 400)
    wave, same = fit("one-wave", 5, 400)        # worth 80 tasks, but there are no more cores
    more, again = fit("bounded-tasks", 5, 20)   # 20 rows at most in each
    assert (one, wave, more) == (1, min(80, cores), max(20, min(80, cores)))
    assert alone == same == again and len(alone) == 400


def test_drawn_rows_are_those_of_the_hash(spark):
    rows = spark.range(-50, 500).select("id", F.xxhash64("id", F.lit(42)).alias("h"), F.xxhash64("id", F.lit(42), F.lit(17)).alias("x")).collect()
    got = B._drawn(np.array([r.h for r in rows]).view("uint64"), 17, 0.8)
    assert got.tolist() == [r.x % 1_000_000 < 800_000 for r in rows] and 0.7 < got.mean() < 0.9
