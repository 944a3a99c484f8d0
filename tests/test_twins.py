"""pandas twins on small random series, property-style with a
fixed seed: W1-W3 lags and rolling means, X10 codes, G21 quartiles, J4 fill."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillcast.operators import features as FE
from tillcast.operators import marts as M
from tillcast.operators.encode import encode

SETTINGS = settings(max_examples=6, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

series = st.lists(st.one_of(st.none(), st.floats(0, 1000, allow_nan=False).map(lambda v: round(v, 2))),
                  min_size=1, max_size=40)


@SETTINGS
@given(a=series, b=series, full=st.booleans())
def test_lags_and_rolling_twin(spark, a, b, full):
    pdf = pd.DataFrame({"k": ["a"] * len(a) + ["b"] * len(b),
                        "t": list(range(len(a))) + list(range(len(b))),
                        "v": pd.array(a + b, dtype="Float64")})
    df = spark.createDataFrame([(r.k, int(r.t), None if pd.isna(r.v) else float(r.v))
                                for r in pdf.itertuples()], "k string, t int, v double")
    out = FE.add_lag_features(df, ["k"], ["t"], [1, 3], [2, 5], full_windows=full, value="v").toPandas()
    out = out.sort_values(["k", "t"]).reset_index(drop=True)
    exp = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = exp.groupby("k")["v"]
    for lag in (1, 3):
        e = g.shift(lag).astype("float64")
        assert np.allclose(out[f"lag_{lag}"].astype("float64"), e, equal_nan=True)
    for k in (2, 5):
        e = g.transform(lambda s: s.astype("float64").shift(1).rolling(k, min_periods=k if full else 1).mean())
        assert np.allclose(out[f"rolling_mean_{k}"].astype("float64"), e.astype("float64"), equal_nan=True)


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.sampled_from(["PULL", "JUPE", "ROBE", "T SHIRT", "Écharpe"])),
                     min_size=1, max_size=30))
def test_codes_twin(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = encode(df, "x").toPandas()
    exp = pd.Series(vals, dtype="object").astype("category").cat.codes
    mapping = dict(zip(vals, exp))
    assert all(mapping[r.x] == r.x_encoded for r in got.itertuples())


@SETTINGS
@given(vals=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=2, max_size=60))
def test_describe_twin(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "q double")
    r = M.describe(df, ["q"]).first()
    d = pd.Series(vals).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert np.isclose(r[ours], d[theirs], rtol=1e-9, atol=1e-6)


@SETTINGS
@given(days=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 20),
                               st.floats(0, 50, allow_nan=False)), min_size=1, max_size=25, unique_by=lambda t: t[:2]))
def test_calendar_fill_twin(spark, days):
    base = dt.date(2022, 1, 1)
    rows = [(f, base + dt.timedelta(days=d), float(q), float(q) * 2, 1) for f, d, q in days]
    df = spark.createDataFrame(rows, "Famille string, Date date, sum_Quantite double, sum_Total double, "
                                     "nb_magasins long")
    got = FE.calendar_fill(df).toPandas().sort_values(["Famille", "Date"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["Famille", "Date", "sum_Quantite", "sum_Total", "nb_magasins"])
    pdf["Date"] = pd.to_datetime(pdf["Date"])
    full = pd.date_range(pdf["Date"].min(), pdf["Date"].max(), freq="D")
    parts = []
    for fam in sorted(pdf["Famille"].unique()):
        f = pdf[pdf["Famille"] == fam].set_index("Date").reindex(full)
        f["Famille"] = fam
        parts.append(f.fillna({"sum_Quantite": 0, "sum_Total": 0, "nb_magasins": 0}).rename_axis("Date").reset_index())
    exp = pd.concat(parts).sort_values(["Famille", "Date"]).reset_index(drop=True)
    assert len(got) == len(exp)
    assert np.allclose(got["sum_Quantite"], exp["sum_Quantite"]) and np.allclose(got["nb_magasins"], exp["nb_magasins"])
    assert list(pd.to_datetime(got["Date"])) == list(exp["Date"])
