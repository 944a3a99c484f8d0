"""Sources and sinks (S3-S9) and the wide prediction table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.operators import evaluate as EV
from tillcast.sources import sinks as SK
from tillcast.sources import versions as VS
from tillcast.sources.tables import read_csv, read_csv_checked, sales, sf_from_dir
from conftest import SF_SMALL


def test_sf_from_dir():
    assert sf_from_dir("/root/testdata/sf0.01") == 0.01
    assert sf_from_dir("/root/testdata/sf0.1/") == 0.1


def test_sales_columns_and_types(spark):
    df = sales(spark, SF_SMALL)
    types = dict(df.dtypes)
    assert types["Date"] == "date" and types["Reception"] == "date" and types["CodeMag"] == "bigint"
    assert types["Prix"] == "double" and types["Famille"] == "string"
    only = sales(spark, SF_SMALL, ["Date", "Quantite"])
    assert only.columns == ["Date", "Quantite"] and only.count() == df.count()


def test_replace_table_and_csv_roundtrip(spark, tmp_path):
    rows = [(dt.date(2022, 1, 3), "A", 2.0), (dt.date(2023, 5, 1), "B", 3.5)]
    df = spark.createDataFrame(rows, "Date date, Famille string, Quantite double")
    SK.replace_table(df.withColumn("year", F.year("Date")), str(tmp_path / "t"), partition_by=["year"],
                     sort_within=["Famille"])
    SK.replace_table(df.withColumn("year", F.year("Date")), str(tmp_path / "t"), partition_by=["year"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and sorted(r["year"] for r in back.collect()) == [2022, 2023]
    SK.write_csv(df, str(tmp_path / "c"))
    again = read_csv(spark, str(tmp_path / "c"), "Date date, Famille string, Quantite double")
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_write_results_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    SK.write_results({"a": df, "b": df}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1
    schema = SK.schema_table(spark, df, primary_key="id").collect()
    assert [(r["COLUMN_NAME"], r["DATA_TYPE"], r["COLUMN_KEY"], r["ORDINAL_POSITION"]) for r in schema] == \
        [("id", "int", "PRI", 1), ("v", "string", "", 2)]
    missing = SK.table_check(spark, "no_such_table").first()
    assert missing["exists"] is False
    counted = SK.table_check(spark, "frame", df).first()
    assert counted["row_count"] == 1


def test_wide_predictions(spark):
    long = spark.createDataFrame(
        [("A", 1.0, "Ridge", 1.5), ("A", 1.0, "GBT", 0.5), ("B", 2.0, "Ridge", 2.5)],
        "k string, y double, model string, p double")
    wide = {r["k"]: r for r in EV.wide_predictions(long, ["k"], "y", ["Ridge", "GBT"]).collect()}
    assert wide["A"]["pred_Ridge"] == 1.5 and wide["A"]["pred_GBT"] == 0.5 and wide["B"]["pred_GBT"] is None


def test_failed_publish_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    assert VS.history(spark, root).count() == 0
    with pytest.raises(ValueError):
        VS.read_version(spark, root)
    one = spark.range(5)
    assert VS.publish(one, root) == 1
    old = VS.read_version(spark, root)
    with pytest.raises(Exception):
        VS.publish(spark.range(9).select(F.expr("if(id = 8, raise_error('lost'), id)").alias("id")), root)
    assert VS.read_version(spark, root).count() == 5 and VS.history(spark, root).count() == 1
    # a reader may publish what it read from the same table
    assert VS.publish(old.filter("id < 3"), root) == 2
    assert old.count() == 5 and VS.read_version(spark, root).count() == 3
    assert VS.read_version(spark, root, 1).count() == 5
    assert sorted(tuple(r)[::2] for r in VS.history(spark, root).collect()) == [(1, 5), (2, 3)]
    with pytest.raises(ValueError):
        VS.read_version(spark, root, 7)
    assert VS.publish(one.limit(0), root) == 3 and VS.read_version(spark, root).count() == 0


def test_checked_csv_names_the_bad_column(spark, tmp_path):
    lines = ["d,n,t", "2022-02-28,1,x", "2022-02-30,1,x", ",,", "2022-02-28,one,x", "2022-02-28,1", "2022-02-28,1,x,y",
             "2022-02-28,one", '2022-02-28,7,"a,b"']
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    good, bad = read_csv_checked(spark, str(tmp_path / "x.csv"), "d date, n int, t string")
    day = dt.date(2022, 2, 28)
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, [
        (day, 1, "x"), (None, None, None), (day, 7, "a,b")]))
    assert sorted(map(tuple, bad.collect())) == sorted([
        ("d", "2022-02-30,1,x"), ("n", "2022-02-28,one,x"), ("fields", "2022-02-28,1"), ("fields", "2022-02-28,1,x,y"),
        ("fields", "2022-02-28,one")])
    assert bad.count() == 5 and good.select("t").count() == 3        # whatever columns are read


def test_feature_counts_and_schema_counts(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("c", None), (None, "X")], "f string, p string")
    got = sorted(tuple(r) for r in SK.feature_counts(df, {"f": 2, "p": None}).collect())
    assert got == [("f", "a", 2), ("f", "b", 1), ("p", "X", 3), ("p", "Y", 1)]
    assert SK.feature_counts(df.limit(0), {"f": 2}).count() == 0
    assert [(r["COLUMN_NAME"], r["COLUMN_KEY"], r["ROW_COUNT"], r["NULL_COUNT"]) for r in SK.schema_counts(df, "f").collect()] == \
        [("f", "PRI", 5, 1), ("p", "", 5, 1)]


def test_chosen_model_leaves_out_the_excluded(spark):
    rows = [("A", 10.0, m, p) for m, p in (("Naive", 10.0), ("x", 9.0), ("y", 7.0))]
    rows += [("B", 10.0, m, p) for m, p in (("Naive", 10.0), ("x", 10.0), ("y", 10.0))]
    long = spark.createDataFrame(rows, "Famille string, y double, model string, p double")
    got = sorted((r["best_model"], r["Famille"], r["RMSE"], r["WMAPE"])
                 for r in EV.chosen_model_metrics(long, "Famille", ["Naive"]).collect())
    assert got == [("x", "A", 1.0, 10.0), ("x", "B", 0.0, 0.0)]
    assert EV.chosen_model_metrics(long, "Famille", ["Naive", "x", "y"]).count() == 0
