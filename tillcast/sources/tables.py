"""Readers (S1-S3) and the ``sales`` fact built from the driver tables.

The sales fact of the reference (one row per ticket line) is mapped onto the
TPC-H-like tables as FIXTURES.md section 2 describes.  Only the dimension
joins a caller needs are planned: a query on Date and Quantite reads lineitem
alone, Reception adds orders, Famille/ArFamille/ArCouleur add part and Pays
adds supplier -> nation -> region.  The joins are left joins on unique keys,
so the row count never depends on the columns asked for: a line whose part or
store is missing keeps its row with null columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.scalars import parse_date

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

SALES_COLUMNS = ["l_orderkey", "l_linenumber", "Date", "Reception", "TypeVente",
                 "CodeMag", "CodeArticle", "Famille", "ArFamille", "ArCouleur",
                 "Saison", "Pays", "Prix", "Quantite", "Total"]

_PART_COLUMNS = {"Famille", "ArFamille", "ArCouleur"}


def sf_from_dir(sf_dir: str) -> float:
    """Scale factor from a folder name such as ``/root/testdata/sf0.01``."""
    m = re.search(r"sf([0-9.]+)", sf_dir.rstrip("/").split("/")[-1])
    return float(m.group(1).rstrip(".")) if m else 1.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a DataFrame (Parquet scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: a CSV with header and an explicit schema (dates parsed by type)."""
    return (spark.read.schema(schema).option("header", True)
            .option("dateFormat", "yyyy-MM-dd").csv(path))


def read_csv_checked(spark: SparkSession, path: str, schema: str, header: bool = True,
                     date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """S3 + X17 for dirty text: (rows of ``schema``, rejects ``(reason, record)``).

    Every field is read as text and then parsed on its own, so one bad value
    rejects its line with the column's name as the reason instead of ending the
    job or becoming null.  Lines with too few or too many fields have the reason
    ``fields``.  Empty fields are null and no reason to reject; a line with
    several bad values takes the first column's name.  Dates are parsed by
    ``date_format``; both results come from one scan plan each.
    """
    fields = T._parse_datatype_string(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField("_bad", T.StringType())])
    # without column pruning a line is judged by all its fields, whatever is selected
    raw = (spark.read.schema(text).option("header", header).option("columnNameOfCorruptRecord", "_bad")
           .option("mode", "PERMISSIVE").option("columnPruning", False).csv(path))

    def parsed(f):
        if isinstance(f.dataType, T.DateType):
            return parse_date(f.name, date_format)
        return F.col(f.name).try_cast(f.dataType)

    wrong = F.coalesce(F.when(F.col("_bad").isNotNull(), F.lit("fields")),
                       *[F.when(F.col(f.name).isNotNull() & parsed(f).isNull(), F.lit(f.name)) for f in fields])
    judged = raw.withColumn("_reason", wrong)
    record = F.coalesce("_bad", F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in fields]))
    return (judged.filter("_reason is null").select(*[parsed(f).alias(f.name) for f in fields]),
            judged.filter("_reason is not null").select(F.col("_reason").alias("reason"), record.alias("record")))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict) -> DataFrame:
    """S1 for a live database: a partitioned JDBC read (one range per task)."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties)


def store_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(CodeMag, Pays): supplier -> nation -> region.

    nation and region are fixed-size TPC-H tables (25 and 5 rows), so they are
    broadcast; supplier grows with the data and is joined by a plain join.
    """
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    return (supplier.join(geo, supplier.s_nationkey == geo.n_nationkey, "left")
            .select(F.col("s_suppkey").alias("CodeMag"), F.col("r_name").alias("Pays")))


def sales(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
          shipped_from: str | None = None) -> DataFrame:
    """The sales fact (one row per ticket line) with the columns asked for.

    Column types: Date/Reception date; TypeVente, Famille, ArFamille, ArCouleur,
    Saison, Pays string; CodeMag, CodeArticle long; Prix, Quantite, Total double.

    ``shipped_from`` keeps only lines shipped on or after that day, as a filter
    on the lineitem column itself so it reaches the Parquet scan.  Give it when
    a later filter needs ``Date >= shipped_from`` anyway (Date is the ship
    date or null), as the cleaning filter does.
    """
    wanted = list(columns) if columns else list(SALES_COLUMNS)
    unknown = set(wanted) - set(SALES_COLUMNS)
    if unknown:
        raise ValueError(f"unknown sales columns: {sorted(unknown)}")

    li = read_table(spark, sf_dir, "lineitem")
    if shipped_from is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(shipped_from).cast("timestamp_ntz"))
    df = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("date"))
         .otherwise(F.to_date("l_shipdate")).alias("Date"),
        F.when(F.col("l_returnflag") == "R", F.lit("RETOUR"))
         .otherwise(F.lit("VENTE")).alias("TypeVente"),
        F.col("l_suppkey").alias("CodeMag"),
        F.col("l_partkey").alias("CodeArticle"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("Saison"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("Prix"),
        F.col("l_quantity").alias("Quantite"),
        F.col("l_extendedprice").alias("Total"),
    )
    if "Reception" in wanted:
        orders = read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey"), F.to_date("o_orderdate").alias("Reception"))
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left").drop("o_orderkey")
    if _PART_COLUMNS & set(wanted):
        part = read_table(spark, sf_dir, "part").select(
            "p_partkey",
            F.col("p_type").alias("Famille"),
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("ArFamille"),
            F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("ArCouleur"))
        df = df.join(part, df.l_partkey == part.p_partkey, "left").drop("p_partkey")
    if "Pays" in wanted:
        geo = store_country(spark, sf_dir).withColumnRenamed("CodeMag", "_geo_mag")
        df = df.join(geo, df.l_suppkey == geo._geo_mag, "left").drop("_geo_mag")
    return df.select(*wanted)


# SQL text of the same view, for the DuckDB oracle.
SALES_SQL = """
select l_orderkey, l_linenumber,
       case when l_linenumber = 7 then null else cast(l_shipdate as date) end as Date,
       cast(o_orderdate as date) as Reception,
       case when l_returnflag = 'R' then 'RETOUR' else 'VENTE' end as TypeVente,
       l_suppkey as CodeMag, l_partkey as CodeArticle, p_type as Famille,
       split_part(p_name, ' ', 2) as ArFamille, nullif(p_brand, 'Brand#7') as ArCouleur,
       concat('Q', cast(quarter(l_shipdate) as varchar(1))) as Saison, r_name as Pays,
       l_extendedprice / l_quantity as Prix, l_quantity as Quantite, l_extendedprice as Total
from lineitem
left join orders on l_orderkey = o_orderkey
left join part on l_partkey = p_partkey
left join supplier on l_suppkey = s_suppkey
left join nation on s_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
"""
