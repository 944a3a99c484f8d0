"""License scan against brute force over all blocks and templates."""

import re

import numpy as np
import pytest

from tillcast.llm import licenses, queries
from tillcast.llm.licenses import NOTICES, PHRASES, Template

from .conftest import EDGE, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def twin(rows, templates):
    """All blocks with all templates, all words with all phrases."""
    half = max(len(words(t.text)) for t in templates)
    out = []
    for doc_id, text in rows:
        w, starts, matches, score = words(text), [], set(), 0.0
        for t in templates:
            v = words(t.text)
            if t.phrase:
                at = [i for i in range(len(w)) if w[i:i + len(v)] == v]
                starts += at
                if at:
                    matches.add((t.label, True))
                    score = 1.0
                continue
            for k in range(0, len(w), half):
                share = len(set(w[k:k + 2 * half]) & set(v)) / len(set(v))
                if share >= t.share - 1e-9:
                    matches.add((t.label, False))
                    score = max(score, share)
        out.append((str(doc_id), len(w), sorted(matches), len(starts), str(min(starts, default=None)),
                    str(max(starts, default=None)), round(score, 9)))
    return sorted(out)


def got_rows(df):
    return sorted((str(r.doc_id), r.n_words, [(m.label, m.phrase) for m in r.matches], r.n_places, str(r.first_word),
                   str(r.last_word), round(r.score, 9)) for r in df.collect())


def test_table_is_brute_force(spark, docs):
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    rows += [(1000 + k, f"intro {t.text.upper()} 4.0 and so on " * 2) for k, t in enumerate(PHRASES + NOTICES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = twin(rows, PHRASES + NOTICES)
    assert got_rows(licenses.scan(df, PHRASES + NOTICES)) == want
    assert {x for r in want for x, _ in r[2]} == {t.label for t in PHRASES + NOTICES}


@pytest.mark.parametrize("seed", range(3))
def test_random_sets_are_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    templates = [Template(f"t{k}", " ".join(f"w{x}" for x in rng.integers(0, 25, int(rng.integers(1, 14)))),
                          float(rng.choice([0.3, 0.5, 0.8, 1.0])), bool(k % 3 == 0)) for k in range(12)]
    rows = [(i, " ".join(f"W{x}" for x in (rng.random(int(rng.integers(0, 120))) ** 2 * 60).astype(int))) for i in range(150)]
    rows += [(i, templates[i % 12].text + " tail") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_rows(licenses.scan(df, templates)) == twin(rows, templates)


def test_query_columns(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op13_licenses"](spark, SF).collect()}
    some = [r for r in rows.values() if r.n_base]
    assert len(rows) == 200 and some and all(0 <= r.score <= 1 for r in rows.values())
    for r in rows.values():
        assert (r.first_word is None) == (r.n_base == 0) == (r.base_labels == "")
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_edge_rows(spark, edge):
    got = got_rows(licenses.scan(edge, PHRASES + NOTICES))
    assert got == twin([(i, t) for i, t, _ in EDGE], PHRASES + NOTICES)
    assert licenses.scan(edge.limit(0), PHRASES).count() == 0
    assert [r.n_places for r in licenses.scan(edge, []).collect()] == [0] * len(EDGE)
    rows = [(1, "CC-BY\ncc by " * 3), (1, "CC-BY\ncc by " * 3), (None, "All rights.  Reserved"), (2, "cc éby"), (3, "accc by ccby")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_rows(licenses.scan(df, PHRASES)) == twin(rows, PHRASES)


def test_very_long_text(spark):
    text = "cc by " * 100_000 + "word " * 300_000 + "general public license"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), PHRASES + NOTICES).collect()[0]
    assert (r.n_words, r.n_places, r.first_word, r.last_word) == (500_003, 100_001, 0, 500_000)


def test_query_is_the_oracle(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(str, con.sql(queries.ORACLES["op13_licenses"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES["op13_licenses"](spark, sf).collect()) == want
