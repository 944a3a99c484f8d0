"""Scoring requests (M13, re-aimed from an HTTP endpoint) and model status.

``score`` is column expressions plus joins to small static frames (the code
table, the supported families and a one-row text of the family list), so the
same function takes a batch DataFrame or a streaming one (stream-static
joins).  Rows that cannot be scored are not dropped: they come out with an
``error`` text, and ``split_scored`` separates the two outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import constants as K
from tillcast.functions.calendar import high_season, iso_week_monday, season_flags
from tillcast.functions.scalars import clip_zero, round_to
from tillcast.operators.encode import broadcast_measured
from tillcast.operators.models import LinearModel

REQUEST_SCHEMA = ("famille string, year int, week_of_year int, lag_1 double, lag_2 double, lag_4 double, "
                  "lag_52 double, rolling_mean_4 double, rolling_mean_12 double")
PREDICTION_COLUMNS = ["famille", "year", "week_of_year", "predicted_quantity"]
REQUEST_NUMBERS = ["lag_1", "lag_2", "lag_4", "lag_52", "rolling_mean_4", "rolling_mean_12"]


def family_choices(supported: DataFrame, key: str = "Famille") -> DataFrame:
    """One row: the sorted supported families as a list text, ``['A', 'B']``."""
    names = F.array_sort(F.collect_set(F.col(key)))
    return supported.agg(F.concat(F.lit("["), F.array_join(
        F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")).alias("_choices"))


def score(requests: DataFrame, model: LinearModel, codes: DataFrame, supported: DataFrame,
          summer_families: list[str] | None = None, winter_families: list[str] | None = None) -> DataFrame:
    """(famille, year, week_of_year, predicted_quantity, error).

    ``codes`` is the (Famille, Famille_encoded) table the model was trained
    with; ``supported`` the families the model serves.  Unknown family or a
    week missing from the ISO year give an error text and no prediction.  The
    two family tables are written and measured here, before requests are read.
    """
    # one static row per family, written and measured, so that requests (few
    # families, so hot keys) are not shuffled to meet it
    ok = supported.select(F.col("Famille").alias("_fam")).distinct().withColumn("_known", F.lit(True))
    code = codes.select(F.col("Famille").alias("_fam"), "Famille_encoded")
    families = broadcast_measured(code.join(ok, "_fam", "full"))
    choices = broadcast_measured(family_choices(families.filter("_known"), "_fam"))
    df = requests.join(families, requests["famille"] == families["_fam"], "left").crossJoin(choices)
    monday = iso_week_monday("year", "week_of_year")
    df = df.withColumn("_monday", monday).withColumn("month", F.month("_monday"))
    df = df.withColumn("quarter", F.floor((F.col("month") - 1) / 3).cast("int") + 1)
    df = df.withColumns(season_flags("month"))
    df = df.withColumn("is_high_season", high_season("famille", "is_summer", "is_winter",
                                                     summer_families, winter_families))
    unknown = F.col("_known").isNull()

    def text(c):       # a missing value prints as None, as in the reference's messages
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))
    # a request must carry every lag value (the reference's request schema
    # declares them all as required numbers)
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUEST_NUMBERS])
    error = (F.when(unknown, F.concat(F.lit("Famille '"), text("famille"),
                                      F.lit("' not supported. Choose from: "), F.col("_choices")))
             .when(F.col("_monday").isNull(), F.concat(
                 F.lit("Invalid ISO week: "), text("year"), F.lit("-W"), text("week_of_year")))
             .when(missing.isNotNull(), F.concat(F.lit("Missing value: "), missing)))
    pred: Column = round_to(clip_zero(model.predict_col()), 2)
    return df.select("famille", "year", "week_of_year",
                     F.when(error.isNull(), pred).alias("predicted_quantity"), error.alias("error"))


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejects)."""
    preds = scored.filter(F.col("error").isNull()).select(*PREDICTION_COLUMNS)
    rejects = scored.filter(F.col("error").isNotNull()).select("famille", "year", "week_of_year", "error")
    return preds, rejects


def model_status(supported: DataFrame, wmape: Column | float = K.MODEL_WMAPE, r2: Column | float = K.MODEL_R2,
                 last_trained: Column | str = K.MODEL_LAST_TRAINED, name: str = K.MODEL_NAME) -> DataFrame:
    """One-row registry: status, name, WMAPE, R2, last trained, sorted families."""
    def lit(v, t):
        return v if isinstance(v, Column) else F.lit(v).cast(t)
    fams = supported.agg(F.array_sort(F.collect_set("Famille")).alias("families_supported"))
    return fams.select(F.lit(K.MODEL_STATUS).alias("status"), F.lit(name).alias("model_name"),
                       lit(wmape, "double").alias("wmape"), lit(r2, "double").alias("r2"),
                       lit(last_trained, "string").alias("last_trained"), "families_supported")
