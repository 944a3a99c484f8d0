"""Collocations against DuckDB and brute force; packing and filters by round trip."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tillcast.llm import collocations as c
from tillcast.llm import queries

from .conftest import EDGE


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 22, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_packing_and_permutation_are_invertible(n, bits):
    rng = np.random.default_rng(bits)
    p = c.Packing(n, bits)
    numbers = [rng.integers(0, 1 << bits, 500) for _ in range(n)]
    left, right = p.pack(numbers)
    assert int(left.max()) < 1 << p.left and int(right.max()) < 1 << p.right
    assert [x.tolist() for x in p.unpack(left, right)] == [x.tolist() for x in numbers]
    moved = p.permute(left, right)
    assert int(moved[0].max()) < 1 << p.left and int(moved[1].max()) < 1 << p.right
    assert all((a == b).all() for a, b in zip(p.restore(*moved), (left, right)))
    want = Counter(zip(moved[0].tolist(), moved[1].tolist()))
    got = p.summed(*moved)
    assert list(zip(*(x.tolist() for x in got))) == [(a, b, k) for (a, b), k in sorted(want.items())]


@pytest.mark.parametrize("bits", [2, 13, 32])
@pytest.mark.parametrize("shard", [0, 1, 2])
def test_filters_are_lossless_and_merge(bits, shard):
    rng = np.random.default_rng(bits + shard)
    p = c.Packing(3, bits)
    shards, want = [], Counter()
    for _ in range(4):
        numbers = [rng.integers(0, min(1 << bits, 40), 3000) for _ in range(3)]
        want.update(zip(*(x.tolist() for x in numbers)))
        left, right, count = p.summed(*p.permute(*p.pack(numbers)))
        count = count + (rng.random(len(count)) < 0.1) * 0
        bucket = (left >> np.uint64(p.left - shard)).astype(int)
        shards += [(b, c.encode(left[bucket == b], right[bucket == b], count[bucket == b], p, shard)) for b in set(bucket.tolist())]
    got = {}
    for b in {b for b, _ in shards}:
        parts = [c.decode(d, p, shard, b) for k, d in shards if k == b]
        left, right, count = p.summed(*(np.concatenate(x) for x in zip(*parts)))
        got |= dict(zip(zip(*(x.tolist() for x in p.unpack(*p.restore(left, right)))), count.tolist()))
    assert got == want


def test_wide_counters():
    p = c.Packing(2, 20)
    left, right = np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)
    count = np.array([1, 254, 255, 256, 1 << 40])
    assert [x.tolist() for x in c.decode(c.encode(left, right, count, p, 0), p, 0, 0)] == [list(range(5))] * 2 + [count.tolist()]


def twin(rows, least=30, covered=80, top=2000):
    """From Counters of word tuples."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    g = (lang, tuple(w[i:i + n]))
                    f[g] = f.get(g, 0) + 1
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(100 * b >= covered * a for (lo, v), b in cand.items() if lo == lang and len(v) > len(w)
               and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s)
                  for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def test_query_is_the_oracle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLES["op12_collocations"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op12_collocations"](spark, sf).collect())
    assert len(want) > 200 and got == want


def test_small_texts_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(("en", "fr", None)[i % 3], " ".join(rng.choice(["a", "B", "c,", "d", "é", "x.y", "z\n"], 30)) + (" Q r s t" if i % 2 else "")) for i in range(90)]
    rows += [("en", None), ("en", ""), (None, "..;"), ("und", "a b a b a b " * 20), ("de", "one two " * 10), ("de", "k k k k k k k k " * 8)]
    df = spark.createDataFrame([(i, lang, t, 1, "w") for i, (lang, t) in enumerate(rows)], "id long, lang string, text string, n int, word string")
    assert sorted(tuple(r) for r in c.collocations(df).collect()) == twin(rows)
    assert sorted(tuple(r) for r in c.collocations(df, least=3, covered=50, top=7).collect()) == twin(rows, 3, 50, 7)


def test_many_chunks_and_buckets_give_the_same_counts(spark):
    rng = np.random.default_rng(4)
    rows = [("en", " ".join(f"w{x}" for x in rng.integers(0, 12, 200))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    one = sorted(tuple(r) for r in c.phrase_counts(df)[1].collect())
    many_w, many = c.phrase_counts(df, chunk_bytes=1000, bucket_keys=100)
    def named(w, p):
        names = {r.id: r.word for r in w.collect()}
        return sorted((r.lang, [names[i] for i in r.ids], r.f) for r in p.collect())
    assert named(many_w, many) == named(*c.phrase_counts(df)) and len(one) > 100


def test_edge_rows(spark, edge):
    df = edge.selectExpr("*", "source as lang")
    got = sorted(tuple(r) for r in c.collocations(df).collect())
    assert got == twin([(s, t) for _, t, s in EDGE])
    assert c.collocations(df.limit(0)).collect() == []
    assert c.collocations(df.filter("doc_id = 4")).collect() == []
