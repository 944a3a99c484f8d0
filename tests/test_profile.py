"""Profiler remarks and texts on hand-made columns (FIXTURES section 3:
all null, unique over 1,000 rows, 3 values, an outlier; X18-X22, K8)."""

import datetime as dt

import pytest

from tillcast import constants as K
from tillcast.operators.profile import column_profile, dimension_profile


@pytest.fixture(scope="module")
def frame(spark):
    n = 1200
    rows = []
    for i in range(n):
        rows.append((i, None, i * 3, i % 3, 1e7 if i == 0 else 1.0, f"t{i}", ["a", "b", "c"][i % 3],
                     dt.date(2022, 1, 1 + i % 5), dt.date(2020, 1, 1) + dt.timedelta(days=i)))
    schema = ("IDLigne long, all_null double, num_unique long, three long, spiky double, txt_unique string, "
              "txt_three string, few_dates date, many_dates date")
    return spark.createDataFrame(rows, schema)


def test_remarks(spark, frame):
    prof = {r["Colonne"]: r for r in column_profile(frame, primary_key="IDLigne").collect()}
    assert prof["IDLigne"]["Interpretation_Auto"] == K.REMARK_PRIMARY_KEY
    assert prof["IDLigne"]["Type_Logique"] == K.TYPE_IDENTIFIER
    assert prof["all_null"]["Interpretation_Auto"] == K.REMARK_UNRELIABLE
    assert prof["all_null"]["Pct_NULL"] == 100.0 and prof["all_null"]["Top_5_Valeurs"] == ""
    assert prof["num_unique"]["Interpretation_Auto"] == K.REMARK_UNIQUE_ID
    assert prof["three"]["Interpretation_Auto"] == K.REMARK_LOW_CARD_NUM
    assert prof["spiky"]["Interpretation_Auto"] == K.REMARK_OUTLIERS
    assert prof["spiky"]["Type_Logique"] == K.TYPE_CONTINUOUS and prof["three"]["Type_Logique"] == K.TYPE_DISCRETE
    assert prof["txt_unique"]["Interpretation_Auto"] == K.REMARK_UNIQUE_ID
    assert prof["txt_three"]["Interpretation_Auto"] == "Faible cardinalité (3 valeurs)"
    assert prof["txt_three"]["Top_5_Valeurs"] == "a (33.3%), b (33.3%), c (33.3%)"
    assert prof["few_dates"]["Interpretation_Auto"] == K.REMARK_FEW_DATES
    assert prof["many_dates"]["Interpretation_Auto"] == "Couvre 1200 jours distincts"
    assert prof["many_dates"]["Top_5_Valeurs"] == "Période : 2020-01-01 → 2023-04-14"
    assert prof["three"]["Top_5_Valeurs"] == "0 (400), 1 (400), 2 (400)"
    assert prof["num_unique"]["Min"] == "0" and prof["num_unique"]["Max"] == "3597"
    assert abs(prof["three"]["Ecart_Type"] - 0.82) < 1e-9 and prof["three"]["Moyenne"] == 1.0


def test_dimension_remarks(spark, frame):
    dims = dimension_profile({"t": frame.select("IDLigne", "three", "all_null", "txt_unique")},
                             {"t": ["IDLigne", "three", "all_null", "txt_unique", "missing_col"]})
    got = {r["Colonne"]: r for r in dims.collect()}
    assert got["IDLigne"]["Interpretation_Auto"] == K.REMARK_DIM_PRIMARY
    assert got["three"]["Interpretation_Auto"] == "Faible cardinalité (3 valeurs)"
    assert got["all_null"]["Interpretation_Auto"] == K.REMARK_UNRELIABLE
    assert got["all_null"]["Top_10_Valeurs"] == K.TOP_VALUES_EMPTY
    assert got["txt_unique"]["Interpretation_Auto"] == K.REMARK_DIM_UNIQUE
    assert got["missing_col"]["Erreur"] is not None and got["missing_col"]["Interpretation_Auto"] is None
    assert got["three"]["Top_10_Valeurs"] == "0 (400), 1 (400), 2 (400)"


def test_median_option(spark, frame):
    import numpy as np
    prof = {r["Colonne"]: r for r in column_profile(frame, median=True, columns=["three", "spiky", "num_unique"])
            .collect()}
    assert prof["three"]["Mediane"] == 1.0 and prof["spiky"]["Mediane"] == 1.0
    assert prof["num_unique"]["Mediane"] == float(np.median(np.arange(1200) * 3))


def test_decimals_keep_their_digits(spark):
    from decimal import Decimal
    rows = [(Decimal("1.000000000000000001"), Decimal("12345678901234567890123456789012345678")),
            (Decimal("1.000000000000000002"), Decimal("12345678901234567890123456789012345679")),
            (Decimal("1.000000000000000003"), None)]
    df = spark.createDataFrame(rows, "small decimal(38,18), wide decimal(38,0)")
    prof = {r["Colonne"]: r for r in column_profile(df).collect()}
    assert prof["small"]["Valeurs_Distinctes"] == 3 and prof["small"]["Min"] == "1.000000000000000001"
    assert prof["small"]["Type_Logique"] == K.TYPE_CONTINUOUS and prof["small"]["Moyenne"] == 1.0
    assert prof["wide"]["Valeurs_Distinctes"] == 2 and prof["wide"]["Max"] == "12345678901234567890123456789012345679"
    assert prof["wide"]["Valeurs_Nulles"] == 1 and prof["wide"]["Pct_NULL"] == 33.33


def test_missing_columns_and_empty_tables_give_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    prof = {r["Colonne"]: r for r in column_profile(df, columns=["a", "b", "c"]).collect()}
    assert list(prof) == ["a", "b", "c"]
    assert prof["a"]["Total_Lignes"] == prof["b"]["Total_Lignes"] == prof["b"]["Valeurs_Distinctes"] == 0
    assert prof["a"]["Top_5_Valeurs"] == "" and prof["a"]["Min"] is None
    assert prof["c"]["Total_Lignes"] is None and prof["c"]["Interpretation_Auto"] == f"{K.PROFILE_ERROR} 'c'"
