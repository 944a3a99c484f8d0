"""Column profiler.

The reference runs one or two queries per column (up to 124 scans for 62
columns).  Here the table is read once, whatever the column count:

* every row becomes one narrow record per column, (column id, value) with the
  value in a typed slot (integer, real, text, date, timestamp), and the
  records are grouped by (column, value) with a row count.  Spark aggregates
  partially in each task, so a column with few values sends a few rows per
  task; a near-unique column shuffles about its size once.
* everything else is read from that group table, which is written to the
  checkpoint folder once: filled and null counts, distinct counts, min and
  max, mean and population deviation (weighted by the counts, in two passes
  for stability) and the top values.
* the top-n pick is a ``row_number() <= n`` window, which Spark plans with a
  partial group limit before the shuffle: at most n rows per column leave a
  task, so no task holds all the values of a column.  Values are turned into
  text only there, on groups, never on input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast import constants as K
from tillcast.functions.scalars import round_to
from tillcast.session import materialize as checkpointed

NUMERIC_SQL = ("int", "bigint", "smallint", "tinyint", "mediumint", "decimal", "float", "double")
INT_SQL = ("int", "bigint", "smallint", "tinyint", "mediumint")
REAL_SQL = ("decimal", "float", "double")
DATE_SQL = ("date", "datetime", "timestamp")
TEXT_SQL = ("varchar", "char", "text", "longtext")


def sql_type(dt: T.DataType) -> str:
    """Spark type -> the SQL type name the reference's rules test."""
    if isinstance(dt, T.IntegerType):
        return "int"
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, T.ShortType):
        return "smallint"
    if isinstance(dt, T.ByteType):
        return "tinyint"
    if isinstance(dt, T.DecimalType):
        return "decimal"
    if isinstance(dt, T.FloatType):
        return "float"
    if isinstance(dt, T.DoubleType):
        return "double"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "varchar"
    return dt.simpleString()


def logical_type(name: str, type_sql: str) -> str:
    """First match wins; any name holding ``ID`` in upper case is an identifier."""
    if name.startswith("ID") or "ID" in name.upper():
        return K.TYPE_IDENTIFIER
    if type_sql in DATE_SQL:
        return K.TYPE_TEMPORAL
    if type_sql in INT_SQL:
        return K.TYPE_DISCRETE
    if type_sql in REAL_SQL:
        return K.TYPE_CONTINUOUS
    if type_sql in TEXT_SQL:
        return K.TYPE_NOMINAL
    return K.TYPE_OTHER


def _slot(dt: T.DataType) -> str:
    """Slot of a column type; every decimal type has its own, so no digit is lost."""
    if isinstance(dt, T.DecimalType):
        return f"v_dec_{dt.precision}_{dt.scale}"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)):
        return "v_long"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "v_dbl"
    if isinstance(dt, T.DateType):
        return "v_date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "v_ts"
    return "v_str"


_SLOT_TYPES = {"v_long": "bigint", "v_dbl": "double", "v_str": "string", "v_date": "date",
               "v_ts": "timestamp_ntz"}


def _slot_types(fields: list[T.StructField]) -> dict[str, str]:
    """The slots records of ``fields`` have, with their types."""
    decimals = sorted({(_slot(f.dataType), f.dataType.simpleString()) for f in fields
                       if isinstance(f.dataType, T.DecimalType)})
    return _SLOT_TYPES | dict(decimals)


def slots_of(vc: DataFrame) -> list[str]:
    return [c for c in vc.columns if c.startswith("v_")]


def _numbers(slots: list[str]) -> list[str]:
    return [s for s in slots if s in ("v_long", "v_dbl") or s.startswith("v_dec_")]


def _records(fields: list[T.StructField], slot_types: dict[str, str]) -> Column:
    """One struct per column: (ci, one typed slot per kind of value)."""
    records = []
    for i, f in enumerate(fields):
        slot = _slot(f.dataType)
        src = F.col(f.name)
        if slot == "v_ts":
            src = src.cast("timestamp_ntz")
        vals = [(src.cast(t) if s == slot else F.lit(None).cast(t)).alias(s) for s, t in slot_types.items()]
        records.append(F.struct(F.lit(i).alias("ci"), *vals))
    return F.array(*records)


def typed_value_counts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(ci, typed slots, nb): one row per column index and distinct value
    (all slots null = the null group of that column)."""
    slots = _slot_types(fields)
    return df.select(F.inline(_records(fields, slots))).groupBy("ci", *slots).agg(F.count(F.lit(1)).alias("nb"))


def value_text(slots: list[str]) -> Column:
    """A typed value as text (as the column would print it)."""
    return F.coalesce(*[F.col(s).cast("string") for s in slots])


def _non_null(slots: list[str]) -> Column:
    cond = F.lit(False)
    for s in slots:
        cond = cond | F.col(s).isNotNull()
    return cond


def column_stats(vc: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Per column index, from the typed value counts: total rows, filled,
    distinct, min, max (as text), mean and population std of numbers (N10:
    MySQL's ``STD()`` is the population deviation)."""
    slots = slots_of(vc)
    # text has no reported range, and leaving it out keeps the aggregation
    # buffers fixed-width (hash aggregate, not a sort-based one)
    ranged = [s for s in slots if s != "v_str"]
    x = F.coalesce(*[F.col(s).cast("double") for s in _numbers(slots)])
    filled = _non_null(slots)
    first = vc.groupBy("ci").agg(
        F.sum("nb").alias("Total_Lignes"),
        F.sum(F.when(filled, F.col("nb")).otherwise(0)).alias("Valeurs_Remplies"),
        F.count_if(filled).alias("Valeurs_Distinctes"),
        *[F.min(s).alias(f"min_{s}") for s in ranged], *[F.max(s).alias(f"max_{s}") for s in ranged],
        (F.sum(x * F.col("nb")) / F.sum(F.when(x.isNotNull(), F.col("nb")))).alias("_mean"))
    # second pass over the (small) group table for a stable variance
    dev = (vc.join(F.broadcast(first.select("ci", "_mean")), "ci")
           .groupBy("ci").agg((F.sum(F.col("nb") * F.pow(x - F.col("_mean"), 2))
                               / F.sum(F.when(x.isNotNull(), F.col("nb")))).alias("_var")))
    lo = F.coalesce(*[F.col(f"min_{s}").cast("string") for s in ranged])
    hi = F.coalesce(*[F.col(f"max_{s}").cast("string") for s in ranged])
    return (first.join(F.broadcast(dev), "ci", "left")
            .select("ci", "Total_Lignes", "Valeurs_Remplies", "Valeurs_Distinctes", lo.alias("Min"),
                    hi.alias("Max"), "_mean", F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))).alias("_std")))


def top_items(vc: DataFrame, n: int) -> DataFrame:
    """K8: per column index, the ``n`` most frequent values as a sorted array of
    (rk, value, nb), ties by value text.  ``row_number() <= n`` is planned with
    a partial group limit before the shuffle (at most n rows per column and
    task travel), and the final array holds at most n items."""
    slots = slots_of(vc)
    texts = vc.filter(_non_null(slots)).select("ci", value_text(slots).alias("value"), "nb")
    rk = F.row_number().over(Window.partitionBy("ci").orderBy(F.desc("nb"), F.asc("value")))
    top = texts.withColumn("rk", rk).filter(F.col("rk") <= n)
    return top.groupBy("ci").agg(F.array_sort(F.collect_list(F.struct("rk", "value", "nb"))).alias("items"))


def format_items(items: Column, label) -> Column:
    """``"v1 (label), v2 (label)"``; ``label`` maps an item to its text."""
    return F.array_join(F.transform(items, lambda x: F.concat(x["value"], F.lit(" ("), label(x), F.lit(")"))),
                        ", ")


def _count_label(x: Column) -> Column:
    return F.format_number(x["nb"], 0)


def column_profile(df: DataFrame, primary_key: str | None = None, top_n: int = 5,
                   columns: list[str] | None = None, materialize: bool = True,
                   median: bool = False) -> DataFrame:
    """The 16-column profile table, one row per column, in column order.

    ``Mediane`` stays null as in the reference, which skips it as too costly;
    ``median=True`` fills it for numeric columns with the exact distributed
    quantile (a few more passes, every result bounded).  A requested column
    that the table lacks gives a row with its name, null numbers and the error
    as its remark; a table without rows gives 0 rows counted for each column."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    missing = [c for c in columns or [] if c not in df.columns]
    vc = typed_value_counts(df, fields)
    if materialize:
        vc = checkpointed(vc)        # the one pass over the table
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, sql_type(f.dataType)) for i, f in enumerate(fields)],
        "ci int, Colonne string, Type_SQL string")
    stats = column_stats(vc, fields)
    # meta, stats and top have one row per profiled column (size fixed by the schema)
    out = (F.broadcast(meta).join(stats, "ci", "left").join(F.broadcast(top_items(vc, top_n)), "ci", "left")
           .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
                         for c in ("Total_Lignes", "Valeurs_Remplies", "Valeurs_Distinctes")}))
    total = F.col("Total_Lignes")
    typ = F.col("Type_SQL")
    is_num = typ.isin(*NUMERIC_SQL)
    is_date = typ.isin(*DATE_SQL)
    out = out.withColumns({
        "top": format_items(F.col("items"), _count_label),
        "top_txt": format_items(F.col("items"), lambda x: F.concat(
            round_to(x["nb"] * 100.0 / total, 1).cast("string"), F.lit("%"))),
        "Valeurs_Nulles": F.col("Total_Lignes") - F.col("Valeurs_Remplies"),
        "Min": F.when(is_num | is_date, F.col("Min")),
        "Max": F.when(is_num | is_date, F.col("Max")),
    }).withColumns({
        "Pct_NULL": round_to(F.try_divide((F.col("Valeurs_Nulles") * 100.0), F.col("Total_Lignes").cast("double")), 2),
        "Moyenne": F.when(is_num, round_to(F.col("_mean"), 2)),
        "Ecart_Type": F.when(is_num, round_to(F.col("_std"), 2)),
        "Mediane": _medians(df, fields) if median else F.lit(None).cast("double"),
        "Clé": F.when(F.col("Colonne") == F.lit(primary_key or ""), F.lit("PRI")).otherwise(F.lit("")),
        "Type_Logique": _logical_type_col(F.col("Colonne"), typ),
    })
    out = out.withColumns({
        "Top_5_Valeurs": F.when(is_date, F.concat(F.lit("Période : "), F.col("Min"), F.lit(" → "), F.col("Max")))
                          .when(is_num, F.coalesce(F.col("top"), F.lit("")))
                          .otherwise(F.coalesce(F.col("top_txt"), F.lit(""))),
        "Interpretation_Auto": remark(is_num, is_date),
    })
    if missing:
        out = out.unionByName(spark.createDataFrame(
            [(len(fields) + j, c, f"{K.PROFILE_ERROR} '{c}'") for j, c in enumerate(missing)],
            "ci int, Colonne string, Interpretation_Auto string"), allowMissingColumns=True)
    return out.orderBy("ci").select(
        "Colonne", "Type_SQL", "Type_Logique", "Clé", "Total_Lignes", "Valeurs_Remplies",
        "Valeurs_Nulles", "Pct_NULL", "Valeurs_Distinctes", "Min", "Max", "Moyenne", "Ecart_Type",
        "Mediane", "Top_5_Valeurs", "Interpretation_Auto")


def _medians(df: DataFrame, fields: list[T.StructField]) -> Column:
    """Exact median of every numeric column, as a column keyed by ``Colonne``."""
    from tillcast.operators.outliers import exact_quantiles_multi
    nums = [f.name for f in fields if sql_type(f.dataType) in NUMERIC_SQL]
    if not nums:
        return F.lit(None).cast("double")
    med = exact_quantiles_multi(df, {c: [0.5] for c in nums})
    return F.create_map(*[v for c in nums for v in (F.lit(c), F.lit(med[c][0]).cast("double"))])[F.col("Colonne")]


def _logical_type_col(name: Column, typ: Column) -> Column:
    """X18 as a column expression (same rule as :func:`logical_type`)."""
    return (F.when(name.startswith("ID") | F.upper(name).contains("ID"), F.lit(K.TYPE_IDENTIFIER))
            .when(typ.isin(*DATE_SQL), F.lit(K.TYPE_TEMPORAL))
            .when(typ.isin(*INT_SQL), F.lit(K.TYPE_DISCRETE))
            .when(typ.isin(*REAL_SQL), F.lit(K.TYPE_CONTINUOUS))
            .when(typ.isin(*TEXT_SQL), F.lit(K.TYPE_NOMINAL))
            .otherwise(F.lit(K.TYPE_OTHER)))


def _fmt(template: str, n: Column) -> Column:
    head, tail = template.split("{n}")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def remark(is_num: Column, is_date: Column) -> Column:
    """X19 (numeric), X20 (date), X21 (text) automatic remarks."""
    pct_null = F.col("Pct_NULL")
    distinct, filled = F.col("Valeurs_Distinctes"), F.col("Valeurs_Remplies")
    mean = F.col("Moyenne")
    mx = F.col("Max").cast("double")
    unreliable = pct_null > 50
    unique = (distinct == filled) & (filled > 1000)
    numeric = (F.when(F.col("Clé") == "PRI", F.lit(K.REMARK_PRIMARY_KEY))
               .when(unreliable, F.lit(K.REMARK_UNRELIABLE))
               .when(unique, F.lit(K.REMARK_UNIQUE_ID))
               # both non-zero and non-null, as Python's truth test in the reference
               .when(F.coalesce(mx != 0, F.lit(False)) & F.coalesce(mean != 0, F.lit(False))
                     & (mx > mean * 1000), F.lit(K.REMARK_OUTLIERS))
               .when(distinct < 10, F.lit(K.REMARK_LOW_CARD_NUM))
               .otherwise(F.lit(K.REMARK_STANDARD_NUM)))
    dates = (F.when(unreliable, F.lit(K.REMARK_UNRELIABLE))
             .when(distinct < 10, F.lit(K.REMARK_FEW_DATES))
             .otherwise(_fmt(K.REMARK_DATE_SPAN, distinct)))
    text = (F.when(unreliable, F.lit(K.REMARK_UNRELIABLE))
            .when(unique, F.lit(K.REMARK_UNIQUE_ID))
            .when(distinct < 10, _fmt(K.REMARK_LOW_CARD_TEXT, distinct))
            .when(distinct > 1000, _fmt(K.REMARK_HIGH_CARD_TEXT, F.format_number(distinct, 0)))
            .otherwise(F.lit(K.REMARK_STANDARD_TEXT)))
    return F.when(is_num, numeric).when(is_date, dates).otherwise(text)


def column_fill(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What G25 reads of the profile, without the value counts: one row per
    column with Colonne, Type_SQL, Type_Logique, Total_Lignes, Valeurs_Nulles
    and Pct_NULL (null for a table without rows), from one aggregate whose
    tasks send a single row each."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f.name)).alias(f"f{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("Colonne"), F.lit(sql_type(f.dataType)).alias("Type_SQL"),
                     F.lit(logical_type(f.name, sql_type(f.dataType))).alias("Type_Logique"),
                     F.col("n").alias("Total_Lignes"), (F.col("n") - F.col(f"f{i}")).alias("Valeurs_Nulles"))
            for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows))).withColumn("Pct_NULL", round_to(
        F.try_divide(F.col("Valeurs_Nulles") * 100.0, F.col("Total_Lignes").cast("double")), 2))


def profile_summary(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns per logical type, and columns over 10 % null (descending),
    of a :func:`column_profile` or a :func:`column_fill`."""
    per_type = profile.groupBy("Type_Logique").agg(F.count(F.lit(1)).alias("nb_colonnes"))
    nulls = (profile.filter(F.col("Pct_NULL") > 10).select("Colonne", "Pct_NULL")
             .orderBy(F.desc("Pct_NULL"), F.asc("Colonne")))
    return per_type, nulls


def dimension_profile(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None,
                      top_n: int = 10) -> DataFrame:
    """G20 + X22 + U1 (union of the per-table results by name): one row per
    (table, column): filled, nulls, percent null,
    distinct, top values ``"v (n)"`` and a remark.  A listed column missing
    from its table gives a row with an error text (``Erreur``)."""
    # every profiled column of every table gets one global index, so all the
    # tables' (column, value) records are grouped by one aggregate: one job
    # and one checkpoint for the whole set of dimensions
    records, meta_rows, errors = None, [], []
    spark = None
    for table, df in tables.items():
        spark = df.sparkSession
        wanted = columns.get(table, df.columns) if columns else df.columns
        present = [c for c in wanted if c in df.columns]
        missing = [c for c in wanted if c not in df.columns]
        if present:
            start = len(meta_rows)
            meta_rows += [(start + i, table, c, i) for i, c in enumerate(present)]
            fields = [df.schema[c] for c in present]
            rec = df.select(F.inline(_records(fields, _slot_types(fields))))
            rec = rec.withColumn("ci", F.col("ci") + F.lit(start))
            records = rec if records is None else records.unionByName(rec, allowMissingColumns=True)
        errors += [(table, c, len(present) + j, f"[UNRESOLVED_COLUMN] column '{c}' not found in {table}")
                   for j, c in enumerate(missing)]
    parts = []
    if records is not None:
        vc = checkpointed(records.groupBy("ci", *slots_of(records)).agg(F.count(F.lit(1)).alias("nb")))
        meta = spark.createDataFrame(meta_rows, "ci int, Table string, Colonne string, pos int")
        stats = column_stats(vc, []).select("ci", "Total_Lignes", "Valeurs_Remplies", "Valeurs_Distinctes")
        top = top_items(vc, top_n).select("ci", format_items(F.col("items"), _count_label).alias("top"))
        parts.append(F.broadcast(meta).join(stats, "ci", "left").join(F.broadcast(top), "ci", "left")
                     .drop("ci").withColumn("Erreur", F.lit(None).cast("string")))
    if errors:
        parts.append(spark.createDataFrame(errors, "Table string, Colonne string, pos int, Erreur string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    distinct = F.coalesce(F.col("Valeurs_Distinctes"), F.lit(0)).cast("bigint")
    out = out.withColumns({
        "Valeurs_Distinctes": F.when(F.col("Erreur").isNull(), distinct),
        "Valeurs_Nulles": F.col("Total_Lignes") - F.col("Valeurs_Remplies"),
    }).withColumn("Pct_NULL", F.when(F.col("Total_Lignes") > 0, round_to(
        F.col("Valeurs_Nulles") * 100.0 / F.col("Total_Lignes"), 2)).otherwise(F.lit(0.0)))
    n = F.col("Valeurs_Distinctes")
    rmk = (F.when(F.col("Colonne").startswith("ID"),
                  F.when(n == F.col("Valeurs_Remplies"), F.lit(K.REMARK_DIM_PRIMARY))
                   .otherwise(F.lit(K.REMARK_DIM_FOREIGN)))
           .when(F.col("Pct_NULL") > 50, F.lit(K.REMARK_UNRELIABLE))
           .when(n < 10, _fmt(K.REMARK_LOW_CARD_TEXT, n))
           .when(n == F.col("Total_Lignes"), F.lit(K.REMARK_DIM_UNIQUE))
           .otherwise(_fmt(K.REMARK_DIM_CATEGORICAL, n)))
    return out.select(
        "Table", "Colonne", "Total_Lignes", "Valeurs_Remplies", "Valeurs_Nulles", "Pct_NULL",
        "Valeurs_Distinctes",
        F.when(F.col("Erreur").isNull(), F.coalesce(F.col("top"), F.lit(K.TOP_VALUES_EMPTY))).alias("Top_10_Valeurs"),
        F.when(F.col("Erreur").isNull(), rmk).alias("Interpretation_Auto"), "Erreur")
