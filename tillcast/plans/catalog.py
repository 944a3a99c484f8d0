"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB
oracle per operator of the inventory.

Every query reads the driver's tables (or what Spark derives from them) in
full.  Outputs round doubles to 6 decimals and use the same column names and
types as the oracle, so the driver can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.scalars import round_to
from tillcast.plans import params as P
from tillcast.sources.tables import SALES_SQL, sales

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand_cif(sql: str) -> str:
    """``cif(cond)`` -> ``cast(count_if(cond) as bigint)`` (DuckDB's count_if is HUGEINT)."""
    out, i = [], 0
    while True:
        j = sql.find("cif(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 4])
            i = j + 4
            continue
        depth, k = 1, j + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"cast(count_if({expand_cif(sql[j + 4:k - 1])}) as bigint)")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand_cif(sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (sums differ in the last bits between engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_to(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ SQL pieces

CLEAN_WHERE = (f"TypeVente = 'VENTE' and Date is not null and Date >= DATE '{P.MIN_DATE}' "
               f"and Prix between {P.PRIX_RANGE[0]} and {P.PRIX_RANGE[1]} "
               f"and Quantite between {P.QUANTITE_RANGE[0]} and {P.QUANTITE_RANGE[1]}")

WITH_SALES = f"with sales as ({SALES_SQL})"
WITH_CLEAN = f"{WITH_SALES}, clean as (select * from sales where {CLEAN_WHERE})"
POSITIVE_WHERE = "Date is not null and Quantite > 0 and Prix > 0"


def sql_pct(part: str, whole: str) -> str:
    return f"round(cast({part} as double) * 100.0 / nullif(cast({whole} as double), 0), 2)"


def clean_frame(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    from tillcast.operators.clean import clean_sales
    need = None
    if columns is not None:
        need = list(dict.fromkeys(list(columns) + ["TypeVente", "Date", "Prix", "Quantite"]))
    # the clean filter keeps Date >= MIN_DATE only, so the scan can skip older ship dates
    df = clean_sales(sales(spark, sf_dir, need, shipped_from=P.MIN_DATE), **P.clean_bounds())
    return df if columns is None else df.select(*columns)
