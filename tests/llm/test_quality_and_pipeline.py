"""Classifier by held-out accuracy; pipeline against a brute-force chain."""

import binascii

import numpy as np
import pandas as pd

import corpus_pipeline
from tillcast.llm import linededup, quality, queries

from .conftest import EDGE, SF
from .test_near_duplicates import simhash_twin
from .test_texts import check_packing, leaks_twin

MID = "/root/testdata/sf0.01"


def test_quality_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, MID).collect()}
    labels = pd.read_parquet(f"{MID}/labels.parquet")
    for doc_id, r in got.items():
        assert r.held_out == (binascii.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = labels[[got[d].held_out for d in labels.doc_id]]
    assert len(held) > 50
    assert np.mean([got[d].predicted == q for d, q in zip(held.doc_id, held.quality)]) >= 0.95


def test_quality_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad $$ junk $$") for i in range(200)], "doc_id long, text string")
    lab = [(i, i % 2) for i in range(200)]
    held = [(i, 1 - q) if binascii.crc32(str(i).encode()) % 5 == 0 else (i, q) for i, q in lab]
    one, two = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (lab, held))
    assert (one == two).all() and one.any()


def test_quality_sample_is_bounded(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'some words' as text")
    labels = spark.range(2000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    w = quality.train(docs, labels, epochs=1, train_rows=50)
    assert w.shape == ((1 << 18) + 1,)


def test_quality_edge_rows(spark, edge):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None), (99, 1), (2, 0)], "doc_id long, quality int")
    out = quality.score(edge, quality.train(edge, labels)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _, _ in EDGE)
    assert all(0 <= r.score <= 1 for r in out)
    none = quality.train(edge, labels.limit(0))
    assert not none.any() and {r.predicted for r in quality.score(edge, none).collect()} == {1}
    assert quality.score(edge.limit(0), none).count() == 0
    kept = quality.keep_good(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == len(EDGE)


def test_ftrl_learns_a_linear_rule():
    rng = np.random.default_rng(0)
    model = quality.Ftrl(6, 0.5, 1.0, 0.01, 0.1)
    for _ in range(2000):
        x = rng.integers(0, 64, 5)
        model.learn(x, np.ones(5), int((x < 32).sum() > 2))
    w = model.weights()
    assert w[:32].min() > w[32:64].max()


def test_pipeline_is_the_chain_of_its_stages(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op6_quality"](spark, SF).collect()}
    rows = {i: t for i, t in zip(docs.doc_id.tolist(), docs.text) if scores[i]}
    stage = corpus_pipeline.quality_classifier(spark, table, SF)
    assert stage.columns == table.columns and {r.doc_id for r in stage.collect()} == set(rows)

    import duckdb
    import hashlib
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())}))
    want = {r[0]: r[3] for r in con.sql(linededup.ORACLE).fetchall()}
    stage = corpus_pipeline.line_dedup(spark, stage, SF)
    assert stage.columns == table.columns
    rows = {r.doc_id: r.text for r in stage.collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items()} == want
    assert all(r.n_chars == len(r.text) for r in stage.collect())

    stage = corpus_pipeline.near_duplicates(spark, stage, SF)
    rows = {int(i): rows[int(i)] for i, _, c in simhash_twin(list(rows.items())) if i == c}
    assert stage.columns == table.columns and {r.doc_id for r in stage.collect()} == set(rows)

    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    gone = {int(i) for i, _, _ in leaks_twin(list(rows.items()), list(zip(bench.item_id.tolist(), bench.text)))}
    stage = corpus_pipeline.benchmark_decontamination(spark, stage, SF)
    rows = {i: t for i, t in rows.items() if i not in gone}
    assert gone and stage.columns == table.columns and {r.doc_id for r in stage.collect()} == set(rows)
    check_packing(corpus_pipeline.run(spark, SF).collect(), list(rows.items()))


def test_pipeline_edge_rows(spark, edge):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (edge, edge.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == edge.columns or name == "packing"
            out.collect()


def test_registered_queries_are_the_dealt_ones():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names and set(E.oracle_sql()) <= names


def test_quality_learns_from_twenty_thousand_rows(spark):
    """Of 12,000 labelled rows each counts: a word that one of them holds has a weight."""
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('q', id) as text")
    labels = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    w = quality.train(docs, labels, bits=24, epochs=1, l1=0.0)
    learnt = [i for i in range(12_000) if binascii.crc32(str(i).encode()) % 5]
    place = [binascii.crc32(b"q%d" % i, 0) & ((1 << 24) - 1) for i in learnt]
    assert (w[place] != 0).all()


def test_each_stage_takes_a_lazily_built_text(spark):
    """The text is an expression over a join and array functions when the stage starts."""
    from pyspark.sql import functions as F
    table = spark.read.parquet(f"{SF}/documents.parquet")
    other = table.select("doc_id", F.split("text", "\n").alias("lines"))
    lazy = table.join(other, "doc_id", "left").withColumn("text", F.expr(
        "case when doc_id % 2 = 0 then array_join(transform(lines, l -> concat(l, '')), '\n') else text end")).select(*table.columns)
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, lazy, SF), stage(spark, table, SF)
        if name != "packing":
            assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
        else:
            assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()
