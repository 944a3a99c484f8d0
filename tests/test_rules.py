"""Hand-made frames for what the driver tables lack: null keys, all-null sums,
ties, accents and '~' in family names, ISO weeks 52/53, empty MAPE masks,
SST = 0 (SURVEY 1.4 N1-N12 and FIXTURES section 3)."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.functions import calendar as CAL
from tillcast.functions.scalars import cap_at, clip_zero, round_to, valid_family
from tillcast.operators import clean as C
from tillcast.operators import evaluate as EV
from tillcast.operators import features as FE
from tillcast.operators import marts as M
from tillcast.operators import select as S
from tillcast.operators.encode import encode


def test_valid_family_pattern(spark):
    names = ["~OLD", "T-SHIRT", "T SHIRT", "GROSSES PIÈCES", "JUPE2", "PULL LONG", "BERMUDA/SHORT", None]
    df = spark.createDataFrame([(n,) for n in names], "Famille string")
    kept = sorted(r[0] for r in df.filter(valid_family("Famille")).collect())
    assert kept == sorted(["T SHIRT", "GROSSES PIÈCES", "PULL LONG", "BERMUDA/SHORT"])


def test_calendar_iso_edges(spark):
    days = [dt.date(2021, 12, 31), dt.date(2022, 1, 1), dt.date(2022, 1, 2), dt.date(2022, 1, 3),
            dt.date(2026, 12, 28), dt.date(2024, 2, 29)]
    df = CAL.add_daily_calendar(spark.createDataFrame([(d,) for d in days], "Date date"))
    got = {r["Date"]: r for r in df.collect()}
    ts = pd.to_datetime(pd.Series(days))
    for d, t in zip(days, ts):
        r = got[d]
        assert r["day_of_week"] == t.dayofweek
        assert r["week_of_year"] == t.isocalendar().week
        assert r["is_weekend"] == int(t.dayofweek >= 5)
        assert r["is_month_start"] == int(t.is_month_start)
        assert r["is_month_end"] == int(t.is_month_end)
    assert got[dt.date(2024, 2, 29)]["is_month_end"] == 1
    assert got[dt.date(2026, 12, 28)]["week_of_year"] == 53


def test_iso_week_monday(spark):
    df = spark.createDataFrame([(2026, 53), (2025, 53), (2022, 1), (2021, 52), (2024, 0)], "y int, w int")
    rows = df.select("y", "w", CAL.iso_week_monday("y", "w").alias("m")).collect()
    got = {(r["y"], r["w"]): r["m"] for r in rows}
    assert got[(2026, 53)] == dt.date.fromisocalendar(2026, 53, 1)
    assert got[(2022, 1)] == dt.date.fromisocalendar(2022, 1, 1)
    assert got[(2021, 52)] == dt.date.fromisocalendar(2021, 52, 1)
    assert got[(2025, 53)] is None     # 2025 has 52 ISO weeks
    assert got[(2024, 0)] is None


def test_weekly_mart_iso_year(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 1), "A", None, 3.0), (dt.date(2021, 12, 29), "A", None, 2.0)],
                               "Date date, Famille string, Pays string, Quantite double")
    r = M.weekly_mart(df).collect()
    assert len(r) == 1 and r[0]["year"] == 2021 and r[0]["week_of_year"] == 52 and r[0]["sum_Quantite"] == 5.0


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, 10.0), (float("nan"), 2.0)], "q double, t double")
    rows = df.select(cap_at("q", F.col("t")).alias("c"), clip_zero(F.lit(-1.0)).alias("z"),
                     clip_zero("q").alias("k")).collect()
    assert rows[0]["c"] is None                  # N5: null stays null
    assert rows[1]["c"] == 5.0
    assert rows[0]["k"] is None                  # N6: null stays null
    assert math.isnan(rows[2]["k"])              # N6: NaN stays NaN
    assert rows[0]["z"] == 0.0


def test_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 3), None), (dt.date(2022, 1, 3), None),
                                (None, 4.0)], "Date date, Quantite double")
    r = M.daily_series(df).collect()
    assert len(r) == 1 and r[0]["Quantite"] == 0.0   # N1 (null day dropped) + N3


def test_lag_null_keys_get_no_lags(spark):
    rows = [(None, i, float(i)) for i in range(5)] + [("A", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "Famille string, t int, sum_Quantite double")
    out = FE.add_lag_features(df, ["Famille"], ["t"], [1], [2], full_windows=True)
    nulls = out.filter(F.col("Famille").isNull()).select("lag_1").collect()
    assert all(r[0] is None for r in nulls)
    a = {r["t"]: r for r in out.filter(F.col("Famille") == "A").collect()}
    assert a[1]["lag_1"] == 0.0 and a[1]["rolling_mean_2"] is None and a[2]["rolling_mean_2"] == 0.5


@pytest.mark.parametrize("full", [False, True])
def test_rolling_means_match_pandas(spark, full):
    vals = [3.0, None, 5.0, 1.0, 8.0, 2.0, None, 4.0, 6.0, 7.0, 1.0, 9.0]
    pdf = pd.DataFrame({"k": ["x"] * len(vals), "t": range(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf.astype({"v": "float64"}).where(pdf.notna(), None))
    out = FE.add_lag_features(df, ["k"], ["t"], [2], [3, 20], full_windows=full, value="v")
    got = {r["t"]: r for r in out.collect()}
    s = pdf["v"]
    for k in (3, 20):
        exp = s.shift(1).rolling(k, min_periods=k if full else 1).mean()
        for t, e in enumerate(exp):
            g = got[t][f"rolling_mean_{k}"]
            assert (g is None and pd.isna(e)) or abs(g - e) < 1e-9
    lag = s.shift(2)
    for t, e in enumerate(lag):
        g = got[t]["lag_2"]
        assert (g is None and pd.isna(e)) or g == e


def test_dominant_ties_and_empty(spark):
    d = dt.date(2022, 1, 3)
    rows = [(d, 1, "F", "RED", "a"), (d, 1, "F", "BLUE", "a"), (d, 1, "F", "", "a"), (d, 1, "F", "", "a"),
            (d, 1, "F", "", "a"), (d, 1, "F", None, "a")]
    df = spark.createDataFrame(rows, "Date date, CodeMag long, Famille string, ArCouleur string, ArFamille string")
    r = FE.dominant_attribute(df).collect()
    assert len(r) == 1 and r[0]["dominant_couleur"] == "BLUE"   # tie -> smallest colour; '' and null ignored


def test_calendar_fill(spark):
    rows = [(dt.date(2022, 1, 1), "A", 1.0, 2.0, 1), (dt.date(2022, 1, 4), "A", 3.0, 1.0, 2),
            (dt.date(2022, 1, 2), "B", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "Date date, Famille string, sum_Quantite double, sum_Total double, nb_magasins long")
    out = FE.calendar_fill(df).orderBy("Famille", "Date").collect()
    assert len(out) == 8
    b2 = [r for r in out if r["Famille"] == "B" and r["Date"] == dt.date(2022, 1, 2)][0]
    assert b2["sum_Quantite"] == 0.0 and b2["nb_magasins"] == 1.0


def test_encode_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("a",)], "x string")
    got = {r["x"]: r["x_encoded"] for r in encode(df, "x").collect()}
    assert got == {"a": 0, "b": 1, "é": 2, None: -1}


def test_code_table_distributed_path(spark):
    from tillcast.operators.encode import code_table
    vals = [(f"v{i:05d}",) for i in range(3000)] * 2
    df = spark.createDataFrame(vals, "x string")
    small = {r["x"]: r["x_encoded"] for r in code_table(df, "x", partitions=1).collect()}
    big = {r["x"]: r["x_encoded"] for r in code_table(df, "x", partitions=7).collect()}
    assert small == big == {f"v{i:05d}": i for i in range(3000)}


def test_encode_is_the_same_past_the_broadcast_bound(spark, monkeypatch):
    from tillcast.operators import encode as EN
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("a",)], "x string")
    small = sorted(encode(df, "x").collect(), key=str)
    monkeypatch.setattr(EN, "BROADCAST_BYTES", 0)
    assert sorted(encode(df, "x").collect(), key=str) == small


def test_top_families_ties(spark):
    df = spark.createDataFrame([("B", 5.0), ("A", 5.0), ("C", 1.0)], "Famille string, sum_Quantite double")
    assert [r[0] for r in S.top_families(df, 2).collect()] == ["A", "B"]


def test_group_guard(spark):
    small = [("S", dt.date(2020, 1, i + 1), 1.0) for i in range(3)]
    big = [("B", dt.date(2019, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(200)] + \
          [("B", dt.date(2024, 6, 1), 1.0)]
    df = spark.createDataFrame(small + big, "Famille string, week_start date, sum_Quantite double")
    kept = {r[0] for r in S.guard_groups(df, "week_start", "2024-01-01", 10, 1).select("Famille").distinct().collect()}
    assert kept == {"B"}


def test_metric_edge_cases(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "y double, p double")
        return df.agg(*EV.metric_columns("y", "p")).first()
    r = run([(1.0, 1.0), (2.0, 3.0), (4.0, 4.0)])       # all y < 5
    assert r["MAPE_5"] is None
    r = run([(0.0, 0.0), (0.0, 1.0)])                   # y all 0
    assert r["WMAPE"] is None and r["R2"] == 0.0
    r = run([(3.0, 3.0), (3.0, 3.0)])                   # constant y, perfect
    assert r["R2"] == 1.0
    r = run([(3.0, 1.0)])                               # one row
    assert math.isnan(r["R2"])
    r = run([(10.0, 8.0), (20.0, 25.0), (5.0, 5.0)])
    assert abs(r["RMSE"] - math.sqrt((4 + 25 + 0) / 3)) < 1e-12
    assert abs(r["WMAPE"] - 7 / 35 * 100) < 1e-12


def test_filter_impact_counts_overlap(spark):
    rows = [("VENTE", dt.date(2023, 1, 1), 10.0, 2.0), ("RETOUR", None, 10.0, 2.0),
            ("VENTE", dt.date(2021, 1, 1), 600.0, 2.0), ("VENTE", dt.date(2023, 1, 1), None, 0.0)]
    df = spark.createDataFrame(rows, "TypeVente string, Date date, Prix double, Quantite double")
    r = C.filter_impact(df).first()
    assert (r["rows_before"], r["rows_after"], r["n_type"], r["n_date_null"], r["n_date_old"],
            r["n_prix"], r["n_quantite"], r["null_prix"]) == (4, 1, 1, 1, 1, 1, 1, 1)


def test_round_to_matches_binary_rounding(spark):
    df = spark.createDataFrame([(33926.77 / 32,), (2.675,), (-1.005,)], "x double")
    got = [r[0] for r in df.select(round_to("x", 2)).collect()]
    exp = [math.floor(v * 100 + 0.5) / 100 if v >= 0 else -math.floor(-v * 100 + 0.5) / 100
           for v in (33926.77 / 32, 2.675, -1.005)]
    assert got == exp


def test_lookup_splits_unknown(spark):
    from tillcast.operators.encode import lookup
    table = spark.createDataFrame([("A", 0), ("B", 1)], "Famille string, Famille_encoded int")
    df = spark.createDataFrame([("A", 1.0), ("Z", 2.0), ("B", 3.0)], "Famille string, v double")
    known, unknown = lookup(df, table, "Famille", "Famille_encoded")
    assert sorted((r["Famille"], r["Famille_encoded"]) for r in known.collect()) == [("A", 0), ("B", 1)]
    assert [r["Famille"] for r in unknown.collect()] == ["Z"] and "Famille_encoded" not in unknown.columns


def test_clean_collation_option(spark):
    rows = [("VENTE", dt.date(2023, 1, 1), 10.0, 2.0), ("vente ", dt.date(2023, 1, 1), 10.0, 2.0)]
    df = spark.createDataFrame(rows, "TypeVente string, Date date, Prix double, Quantite double")
    assert C.clean_sales(df).count() == 1
    assert df.filter(C.clean_predicate(collation="UTF8_LCASE_RTRIM")).count() == 2


def test_sample_rows_stable_under_repartition(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = {r[0] for r in C.sample_rows(df, 0.1, seed=7, keys=["k"]).collect()}
    b = {r[0] for r in C.sample_rows(df.repartition(13), 0.1, seed=7, keys=["k"]).collect()}
    assert a == b and 1700 < len(a) < 2300
    other = {r[0] for r in C.sample_rows(df, 0.1, seed=8, keys=["k"]).collect()}
    assert other != a


def test_store_features_null_store(spark):
    base = dt.date(2022, 1, 1)
    rows = []
    for i in range(40):
        d = base + dt.timedelta(days=i)
        rows.append((d, 1, "A", 2.0, 20.0, "RED", "rod"))
        rows.append((d, 1, "A", 1.0, 10.0, "BLUE", "rod"))
        rows.append((d, 1, "A", 1.0, 10.0, "BLUE", "gear"))
        rows.append((d, None, "A", 5.0, 50.0, "RED", "rod"))
    clean = spark.createDataFrame(rows, "Date date, CodeMag long, Famille string, Quantite double, Total double, "
                                        "ArCouleur string, ArFamille string")
    stores = spark.createDataFrame([(1, "EUROPE")], "CodeMag long, Pays string")
    out = FE.store_features(clean, with_dominant=True, stores=stores).collect()
    assert len(out) == 40 - 28 and all(r["CodeMag"] == 1 for r in out)
    first = min(out, key=lambda r: r["Date"])
    assert first["lag_28"] == 4.0 and first["rolling_mean_7"] == 4.0
    assert first["dominant_couleur"] == "BLUE" and first["dominant_sfamille"] == "gear"   # tie -> smallest pair


def test_split_leaves_out_rows_without_a_date(spark):
    from tillcast.operators.select import split_counts
    df = spark.createDataFrame([("2021-01-01",), ("2022-01-01",), (None,)], "d string").selectExpr("cast(d as date) as d")
    got = {r["split"]: r["rows"] for r in split_counts(df, "d", "2022-01-01").collect()}
    assert got == {"train": 1, "test": 1}


def test_sales_rows_do_not_depend_on_the_columns(spark, tmp_path):
    from tillcast.sources.tables import read_table, sales
    for name in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        df = read_table(spark, "/root/testdata/sf0.001", name)
        if name in ("part", "supplier"):
            df = df.filter(f"{name[0]}_{name}key > 2" if name == "part" else "s_suppkey > 2")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    counts = {c: sales(spark, str(tmp_path), [c]).count() for c in ("Date", "Famille", "Pays", "Reception")}
    assert len(set(counts.values())) == 1
    assert sales(spark, str(tmp_path), ["Pays"]).filter("Pays is null").count() > 0


def test_calendar_fill_edges_and_one_scan(spark):
    """Days before a key's first and after its last row; rows without key or day; empty input."""
    import datetime as dt
    from tillcast.operators.features import calendar_fill
    day = lambda k: dt.date(2022, 1, k)
    rows = [("A", day(1), 2.0), ("A", day(4), None), ("B", day(3), 5.0), (None, day(2), 1.0), ("C", None, 1.0)]
    df = spark.createDataFrame(rows, "Famille string, Date date, q double")
    got = sorted(tuple(r) for r in calendar_fill(df, measures=("q",)).collect())
    want = [(day(k), f, {("A", 1): 2.0, ("B", 3): 5.0}.get((f, k), 0.0)) for k in range(1, 5) for f in "AB"]
    assert got == sorted(want)
    assert calendar_fill(df.limit(0), measures=("q",)).count() == 0


@pytest.mark.parametrize("unit", ["D", "W"])
@pytest.mark.parametrize("full", [True, False])
def test_date_lags_equal_fill_then_row_lags(spark, unit, full):
    """Against pandas: reindex to the whole calendar, shift and roll there."""
    import datetime as dt
    import numpy as np
    import pandas as pd
    from tillcast.operators.features import add_date_lags
    rng, step = np.random.default_rng(3), {"D": 1, "W": 7}[unit]
    base, rows = dt.date(2021, 12, 27), []
    for key in "AB":
        for k in sorted(rng.choice(60, 25, replace=False).tolist()):
            rows.append((key, base + dt.timedelta(days=k * step), float(rng.integers(1, 99))))
    df = spark.createDataFrame(rows + [(None, base, 1.0), ("A", None, 1.0)], "k string, d date, v double")
    got = add_date_lags(df, ["k"], "d", [1, 3], [4], full, value="v", unit=unit, fill=0.0)
    gone = [r for r in got.collect() if r["k"] is None or r["d"] is None]
    assert len(gone) == 2 and all(r["lag_1"] is None and r["rolling_mean_4"] is None for r in gone)
    frame = pd.DataFrame(rows, columns=["k", "d", "v"])
    for key, part in frame.groupby("k"):
        s = part.set_index(pd.to_datetime(part["d"]))["v"]
        s = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq=f"{step}D"), fill_value=0.0)
        want = pd.DataFrame({"lag_1": s.shift(1), "lag_3": s.shift(3),
                             "rolling_mean_4": s.shift(1).rolling(4, min_periods=4 if full else 1).mean()})
        for r in got.filter((got.k == key) & got.d.isNotNull()).collect():
            for c in want.columns:
                w = want.loc[pd.Timestamp(r["d"]), c]
                assert (r[c] is None and np.isnan(w)) or abs(r[c] - w) < 1e-9


def test_date_lags_without_fill_leave_gaps_null(spark):
    import datetime as dt
    from tillcast.operators.features import add_date_lags
    rows = [("A", dt.date(2022, 1, 1), 2.0), ("A", dt.date(2022, 1, 2), 4.0), ("A", dt.date(2022, 1, 5), 8.0)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = add_date_lags(df, ["k"], "d", [1, 3], [3], False, value="v").orderBy("d").collect()
    assert [(r["lag_1"], r["lag_3"], r["rolling_mean_3"]) for r in got] == [(None, None, None), (2.0, None, 2.0), (None, 4.0, 4.0)]
    with pytest.raises(ValueError):
        add_date_lags(df, ["k"], "d", [1], [], False, value="v", unit="M")


def test_country_mart_with_late_stores_equals_the_early_join(spark):
    from tillcast.operators.marts import country_daily_mart
    import datetime as dt
    day = dt.date(2022, 1, 3)
    rows = [(day, 1, "A", 2.0, 20.0), (day, 1, "A", 1.0, 5.0), (day, 2, "A", 1.0, 9.0), (day, 3, "A", 7.0, 70.0),
            (day, None, "A", 4.0, 4.0), (day, 9, "B", 4.0, 4.0), (None, 2, "B", None, 3.0), (day, 2, None, 1.0, 1.0)]
    sales = spark.createDataFrame(rows, "Date date, CodeMag long, Famille string, Quantite double, Total double")
    stores = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (4, "X"), (None, "X")], "CodeMag long, Pays string")
    early = country_daily_mart(sales.join(stores, "CodeMag", "left"), "X")
    late = country_daily_mart(sales, "X", stores)
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect())) and late.count() == 3


def test_column_fill_counts_nulls_of_every_type(spark):
    from tillcast.operators.profile import column_fill, profile_summary
    df = spark.createDataFrame([(1, None, 2.0), (None, None, None), (3, "x", 4.0), (4, "y", 5.0)], "IDx int, t string, d double")
    got = {r["Colonne"]: (r["Type_Logique"], r["Total_Lignes"], r["Valeurs_Nulles"], r["Pct_NULL"]) for r in column_fill(df).collect()}
    from tillcast import constants as K
    assert got == {"IDx": (K.TYPE_IDENTIFIER, 4, 1, 25.0), "t": (K.TYPE_NOMINAL, 4, 2, 50.0), "d": (K.TYPE_CONTINUOUS, 4, 1, 25.0)}
    per_type, nulls = profile_summary(column_fill(df.limit(0)))
    assert nulls.count() == 0 and per_type.count() == 3
    assert [r["Colonne"] for r in profile_summary(column_fill(df))[1].collect()] == ["t", "IDx", "d"]


def test_a_table_over_the_bound_is_not_broadcast(spark):
    from tillcast.operators.encode import broadcast_measured
    df = spark.createDataFrame([("a" * 100, 1), (None, 2)], "k string, v int")

    def hinted(out):
        return "broadcast" in out._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_measured(df)) and not hinted(broadcast_measured(df, limit=50))
    assert broadcast_measured(df.limit(0)).count() == 0
