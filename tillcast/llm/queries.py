"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import (collocations, decontaminate, embeddings, htmltext, licenses, linededup, packing, periodic, quality,
                          secrets, simhash, substrings, urlfilter)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules that the url query judges by.
URL_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


@_register
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op3_url_filter"] = urlfilter.oracle(URL_RULES)


@_register
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


@_register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_register
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


@_register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"), passage_words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = linededup.ORACLE


@_register
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans",
                      "n_example", "n_live")


@_register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; texts of every tenth id by hash repeat a stretch of words to their end.

    With h = crc32 of the decimal doc_id, g = h div 10 and n words, word i >= a of
    a text with h mod 10 = 0 becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8).  All other texts (null ids too) stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = (base.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
              .withColumn("words", F.when(F.col("g").isNotNull(), words))
              .withColumn("n", F.size("words"))
              .withColumn("a", F.expr("case when n > 0 then g % n end"))
              .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), "
                      "i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def periodic_digest(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row per document: its runs, their strongest (by exact length over period) and digests."""
    out = periodic.collapse(planted_runs(docs) if plant else docs)
    # a / b > c / d for positive whole numbers is a * d > c * b
    best = F.expr("""aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) ->
        case when b is null or cast(r.length as decimal(20,0)) * b.period > cast(b.length as decimal(20,0)) * r.period
             then r else b end)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (out.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")))


@_register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digest(_table(spark, sf_dir, "documents"))


@_register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = collocations.ORACLE


@_register
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"), licenses.PHRASES + licenses.NOTICES)
    base = F.expr("array_join(array_sort(array_distinct(transform(filter(matches, m -> m.phrase), m -> m.label))), ',')")
    every = F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.label))), ',')")
    return out.select("doc_id", "n_words", F.col("n_places").alias("n_base"), "first_word", "last_word",
                      base.alias("base_labels"), every.alias("labels"), "score")


ORACLES["op13_licenses"] = licenses.oracle(licenses.PHRASES + licenses.NOTICES)
