"""Parameters of the registered queries for the driver's tables.

The reference's own values (dates in 2021-2025, prices up to 500, French
families) do not fit the TPC-H-like test tables, so the registered queries
pass these values instead (FIXTURES.md section 2).  The library defaults stay
the reference's.
"""

from __future__ import annotations

COUNTRY = "EUROPE"
PRIX_RANGE = (0, 5000)
QUANTITE_RANGE = (1, 40)
MIN_DATE = "1996-01-01"
RECEPTION_RANGE = ("1996-01-01", "2000-12-31")
TEST_CUT = "2000-01-01"
TEST_CUT_LATE = "2001-01-01"
SUMMER_FAMILIES = ["ECONOMY", "PROMO"]
WINTER_FAMILIES = ["LARGE", "MEDIUM"]
EXCLUDE = ["STANDARD"]
TOP_K = 3
# mean weekly sum_Quantite a family needs (C1); the same at every data size
THRESHOLD = 240.0


def clean_bounds() -> dict:
    return dict(min_date=MIN_DATE, prix_range=PRIX_RANGE, quantite_range=QUANTITE_RANGE)
