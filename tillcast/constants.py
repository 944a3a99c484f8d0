"""Fixed values.

These must equal the reference's values for right results (filter bounds,
name lists, feature orders, output texts).  They are stated plainly, in their
natural order, and used by name everywhere else.
"""

# ---- fixed values: columns removed by the cleaning step (>60% null or technical)
DROPPED_COLUMNS = [
    "Observation", "LigneTicket", "CodeSaison", "ArSaison", "DiscountPercentage",
    "DiscountAmount", "TotalHT", "ArCode", "Article", "VATAmount", "StoreCategory",
    "idArSaison", "isSynchronised", "IDFactureDiva", "isFacture", "ligne",
    "Defecttrt", "IDLigneTicketClient",
]

# ---- fixed values: default clean-row filter
CLEAN_SALE_TYPE = "VENTE"
CLEAN_MIN_DATE = "2022-01-01"
CLEAN_PRIX_RANGE = (0, 500)
CLEAN_QUANTITE_RANGE = (1, 100)

# ---- fixed values: comparison suite reception range
RECEPTION_RANGE = ("2021-01-01", "2025-12-31")

# ---- fixed values: valid product-family names
VALID_FAMILY_PATTERN = r"^[A-Za-zÀ-ÿ/\s]+$"
INVALID_FAMILY_PREFIX = "~"

# ---- fixed values: calendar month sets
SUMMER_MONTHS = [6, 7, 8]
WINTER_MONTHS = [12, 1, 2]
SOLDES_MONTHS = [1, 7]

# ---- fixed values: families in season
SUMMER_FAMILIES = ["BERMUDA", "BERMUDA/SHORT", "SHORT", "T-SHIRT",
                   "TEE-SHIRT", "T SHIRT SANS MANCHES", "T SHIRT MANCHES COUR"]
WINTER_FAMILIES = ["MANTEAU", "PULL", "BONNETERIE", "BONNETERIE/COIFFANT",
                   "GILET", "SWEAT", "SWEATSHIRT"]

# ---- fixed values: non-core families left out of the weekly models.  The
# reference's list has one more entry, the retailer's own house-brand family;
# it is data specific and is passed by the caller through ``exclude=``.
EXCLUDED_FAMILIES = ["BIJOUX", "CHAUSSURE", "DIVERS", "CUIR PAM",
                     "MAROQUINERIE", "GROSSES PIÈCES"]

# ---- fixed values: high-volume filter and time splits
MIN_MEAN_WEEKLY_SALES = 500
TEST_CUT = "2024-01-01"
TEST_CUT_LATE = "2025-01-01"
MIN_TARGET = 2
MAPE_MIN_TARGET = 5
TOP_FAMILIES = 10

# ---- fixed values: lags and rolling windows
STORE_LAGS = [7, 14, 28]
STORE_ROLLING = [7, 30]
WEEKLY_LAGS_V1 = [1, 2, 4]
WEEKLY_LAGS_V2 = [1, 2, 4, 52]
WEEKLY_ROLLING = [4, 12]

# ---- fixed values: ordered feature lists
DAILY_FEATURES_17 = [
    "year", "month", "day", "day_of_week", "week_of_year",
    "quarter", "is_weekend", "is_month_start", "is_month_end",
    "Pays_encoded", "Famille_encoded", "CodeMag_encoded",
    "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_mean_30",
]
DAILY_FEATURES_16 = [
    "year", "month", "day", "day_of_week", "week_of_year",
    "quarter", "is_weekend", "is_month_start", "is_month_end",
    "Pays_encoded", "CodeMag_encoded",
    "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_mean_30",
]
DAILY_FEATURES_16_V4 = [
    "year", "month", "day", "day_of_week", "week_of_year",
    "quarter", "is_weekend", "is_month_start", "is_month_end",
    "Famille_encoded", "CodeMag_encoded",
    "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_mean_30",
]
DAILY_FEATURES_15 = [
    "year", "month", "day", "day_of_week", "week_of_year",
    "quarter", "is_weekend", "is_month_start", "is_month_end",
    "Famille_encoded",
    "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_mean_30",
]
WEEKLY_FEATURES_13 = [
    "year", "week_of_year", "month", "quarter",
    "is_summer", "is_winter", "is_soldes",
    "Famille_encoded",
    "lag_1", "lag_2", "lag_4",
    "rolling_mean_4", "rolling_mean_12",
]
WEEKLY_FEATURES_14_V8 = [
    "year", "week_of_year", "month", "quarter",
    "is_summer", "is_winter", "is_soldes", "is_high_season",
    "Famille_encoded",
    "lag_1", "lag_2", "lag_4",
    "rolling_mean_4", "rolling_mean_12",
]
WEEKLY_FEATURES_15 = [
    "year", "week_of_year", "month", "quarter",
    "is_summer", "is_winter", "is_soldes", "is_high_season",
    "Famille_encoded",
    "lag_1", "lag_2", "lag_4", "lag_52",
    "rolling_mean_4", "rolling_mean_12",
]
WEEKLY_FEATURES_PER_FAMILY = [
    "year", "week_of_year", "month", "quarter",
    "is_summer", "is_winter", "is_soldes", "is_high_season",
    "lag_1", "lag_2", "lag_4", "lag_52",
    "rolling_mean_4", "rolling_mean_12",
]
TARGET = "sum_Quantite"

# ---- fixed values: model settings
RIDGE_ALPHA = 1.0
GBT_SEED = 42
SUBSAMPLE = 0.8
COLSAMPLE = 0.8
CHANGEPOINTS = 25               # places where a trend may change its slope
CHANGEPOINT_RANGE = 0.8         # share of the training period they are spread over
CHANGEPOINT_PRIOR = 0.1         # scale of the prior on the changes
FOURIER_ORDER = 10              # yearly sine and cosine pairs

# ---- fixed values: saved-model status
MODEL_NAME = "Ridge (alpha=1.0) — Global Model"
MODEL_WMAPE = 63.62
MODEL_R2 = 0.4645
MODEL_LAST_TRAINED = "2026-04-07"
MODEL_STATUS = "healthy"

# ---- fixed values: metric constants
FLOAT_EPS = 2.220446049250313e-16
MAPE_EMPTY_V3 = 999.0

# ---- fixed values: logical column types (profile)
TYPE_IDENTIFIER = "Identifiant numérique"
TYPE_TEMPORAL = "Temporelle"
TYPE_DISCRETE = "Numérique discrète"
TYPE_CONTINUOUS = "Numérique continue"
TYPE_NOMINAL = "Catégorique nominale"
TYPE_OTHER = "Autre"

# ---- fixed values: automatic remarks (profile)
REMARK_PRIMARY_KEY = "Clé primaire"
REMARK_UNRELIABLE = "Colonne peu fiable (>50% NULL)"
REMARK_UNIQUE_ID = "Probablement un identifiant unique"
REMARK_OUTLIERS = "Outliers extrêmes détectés"
REMARK_LOW_CARD_NUM = "Faible cardinalité (booléen/énuméré)"
REMARK_STANDARD_NUM = "Variable numérique standard"
REMARK_FEW_DATES = "Peu de dates distinctes, vérifier cohérence"
REMARK_DATE_SPAN = "Couvre {n} jours distincts"
REMARK_LOW_CARD_TEXT = "Faible cardinalité ({n} valeurs)"
REMARK_HIGH_CARD_TEXT = "Haute cardinalité ({n} valeurs distinctes)"
REMARK_STANDARD_TEXT = "Variable catégorique standard"
REMARK_DIM_PRIMARY = "Clé primaire ou identifiant unique"
REMARK_DIM_FOREIGN = "Clé étrangère"
REMARK_DIM_UNIQUE = "Identifiant unique ou label unique"
REMARK_DIM_CATEGORICAL = "Variable catégorique ({n} valeurs distinctes)"
PROFILE_ERROR = "Erreur : colonne absente"
TOP_VALUES_EMPTY = "Aucune valeur"
TOP_VALUES_PERIOD = "Période : {min} → {max}"
