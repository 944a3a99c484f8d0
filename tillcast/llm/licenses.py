"""License scan: exact set-similarity join of text blocks with templates.

Blocks are overlapping stretches of words, twice as long as the longest
template, one starting every half, so each place of a template lies in a block
as a whole.  The tokens of all templates are put in order of their frequency in
the corpus, rarest first; a block is its set of such tokens.  A template of T
tokens is contained if a block holds at least ``need`` of them.  Then the
first T - need + 1 tokens of the template and the first |block| - need + 1 of
the block share one (prefix filter), the block has at least ``need`` tokens
(length filter), and enough tokens follow the shared one on both sides
(positional filter).  Pairs that pass are counted exactly.  A phrase is a
template of which all words must also stand consecutively.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import small_batches, text_bytes, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters past ASCII; A-Z lower-cased."""
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """``share`` of the text's distinct words must stand in a block; ``phrase``: consecutively, all of them."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False


#: The phrases every scan reports.
PHRASES = [
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
]

#: Notices of widely used licenses, in their usual wording.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("mit", "Released under the MIT License", 1.0),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                    "and associated documentation files"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                    "GNU General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
]


def _counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences in all texts of the templates' words (at most one row for each of these comes back)."""
    def work(batches):
        seen: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text in text_bytes(batch.column(0)):
                seen.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         names=["token", "n"])
    rows = docs.select("text").mapInArrow(work, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in rows.collect()}


def _blocks(rank: dict[bytes, int], rare: frozenset[int], half: int):
    """Numbers of words, and the blocks that hold a token of some template's prefix."""
    hit = pa.struct([("p", pa.int32()), ("r", pa.int32())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("tokens", pa.list_(pa.int32())), ("hits", pa.list_(hit))]))

    def blocks(words: list[bytes]) -> list[dict]:
        cells: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(words):
            r = rank.get(w)
            if r is not None:
                cells.setdefault(p // half, []).append((p, r))
        out = []
        for k in sorted({c for cell, hits in cells.items() if any(r in rare for _, r in hits) for c in (cell - 1, cell) if c >= 0}):
            hits = cells.get(k, []) + cells.get(k + 1, [])
            out.append({"start": k * half, "tokens": sorted({r for _, r in hits}), "hits": [{"p": p, "r": r} for p, r in hits]})
        return out

    def work(batches):
        for batch in small_batches(batches, "text"):
            split = [words_of(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([blocks(w) for w in split], kind)], names=["doc_id", "text_key", "n_words", "blocks"])

    return work


def scan(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """``(doc_id, n_words, matches, n_places, first_word, last_word, score)``, one row per input row.

    ``matches`` is a sorted array of (label, phrase: boolean) of the templates
    found, phrases at exact places and others by containment; ``n_places`` counts
    all places of phrases, ``first_word`` and ``last_word`` are the smallest and
    largest word they start at (words from 0; null without one); ``score`` is the
    largest containment of a template found, 0 without any.  Null and empty texts
    have no words and no matches.  Rows are judged by their own text, also where
    ids are null or repeated; an empty table gives no rows.  The templates are a
    list of the caller's, so what is sent to tasks is as long as that list.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"),
                       F.col("text").cast("string"))
    worded = [(t, words_of(t.text.encode())) for t in templates]
    worded = [(t, w) for t, w in worded if w]
    counts = _counts(base, frozenset(x for _, w in worded for x in w))
    rank = {w: k for k, w in enumerate(sorted({x for _, ws in worded for x in ws}, key=lambda w: (counts.get(w, 0), w)))}
    prefixes, table = [(-1, -1, 0, 1, 1)], [(-1, "", False, 1.0, 1, [-1], [-1])]
    for k, (t, w) in enumerate(worded):
        tokens = sorted({rank[x] for x in w})
        need = len(tokens) if t.phrase else max(1, ceil(t.share * len(tokens) - 1e-9))
        table.append((k, t.label, t.phrase, t.share, need, tokens, [rank[x] for x in w]))
        prefixes += [(k, r, i, len(tokens), need) for i, r in enumerate(tokens[:len(tokens) - need + 1])]
    half = max([1, *(len(w) for _, w in worded)])
    rows = written(base.mapInArrow(
        _blocks(rank, frozenset(r for _, r, *_ in prefixes), half),
        "doc_id long, text_key long, n_words long, "
        "blocks array<struct<start:int,tokens:array<int>,hits:array<struct<p:int,r:int>>>>"), "blocks")
    prefix = spark.createDataFrame(prefixes, "template int, token int, i int, t_size int, need int")
    whole = spark.createDataFrame(table, "template int, label string, phrase boolean, share double, need int, "
                                         "t_tokens array<int>, seq array<int>")
    pairs = (rows.filter(F.size("blocks") > 0)
             .select("doc_id", "text_key", F.inline("blocks"))
             .select("*", F.size("tokens").alias("b_size"), F.posexplode("tokens").alias("j", "token"))
             .join(prefix, "token")
             .filter("b_size >= need and j <= b_size - need and 1 + least(t_size - 1 - i, b_size - 1 - j) >= need")
             .groupBy("doc_id", "text_key", "start", "template")
             .agg(F.first("tokens").alias("tokens"), F.first("hits").alias("hits")))
    places = F.expr(f"""filter(hits, h -> h.r = seq[0] and h.p < start + {half} and forall(
        sequence(0, size(seq) - 1), d -> array_contains(hits, named_struct('p', h.p + d, 'r', seq[d]))))""")
    found = (pairs.join(whole, "template")
             .withColumn("shared", F.size(F.array_intersect("tokens", "t_tokens"))).filter("shared >= need")
             .withColumn("places", F.when(F.col("phrase"), F.transform(places, lambda h: h["p"])))
             .filter("not phrase or size(places) > 0")
             .groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_set(F.struct("label", "phrase"))).alias("matches"),
                  F.sum(F.when(F.col("phrase"), F.size("places"))).alias("n_places"),
                  F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
                  F.max(F.col("shared") / F.size("t_tokens")).alias("score")))
    found = found.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
            .select("doc_id", "n_words",
                    F.coalesce("matches", F.expr("cast(array() as array<struct<label:string,phrase:boolean>>)")).alias("matches"),
                    F.coalesce(F.col("n_places").cast("long"), F.lit(0).cast("long")).alias("n_places"),
                    F.col("first_word").cast("long"), F.col("last_word").cast("long"), F.coalesce("score", F.lit(0.0)).alias("score")))


def oracle(templates: list[Template]) -> str:
    """DuckDB SQL of the query: every block with every template, every word with every phrase."""
    rows = [(t, [w.decode() for w in words_of(t.text.encode())]) for t in templates]
    half = max(len(w) for _, w in rows)
    values = ",\n  ".join(f"('{t.label}', {str(t.phrase).lower()}, {t.share}::double, {w})" for t, w in rows)
    return rf"""
with t(label, phrase, share, v) as (values
  {values}),
d as materialized (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
places as (
  select rid, label, i - 1 as p
  from (select rid, w, label, v, unnest(generate_series(1, len(w) - len(v) + 1)) as i
        from d, t where phrase and len(w) >= len(v) and list_contains(w, v[1]))
  where w[i:i + len(v) - 1] = v),
blocks as (
  select rid, list_distinct(w[k * {half} + 1:(k + 2) * {half}]) as b
  from (select rid, w, unnest(generate_series(0, (len(w) - 1) // {half})) as k from d where len(w) > 0)),
contained as (
  select rid, label, len(list_intersect(b, list_distinct(v))) / len(list_distinct(v)) as found
  from blocks, t where not phrase and len(list_intersect(b, list_distinct(v))) >= share * len(list_distinct(v)) - 1e-9),
labelled as (
  select rid, label, true as base, 1.0::double as found from places union all select rid, label, false, found from contained),
named as (
  select rid, coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(found) as score
  from labelled group by rid),
counted as (select rid, count(*) as n_base, min(p) as first_word, max(p) as last_word from places group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join named using (rid) left join counted using (rid)"""
