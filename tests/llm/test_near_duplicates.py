"""SimHash and embedding near-duplicates against brute force."""

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from tillcast.llm import embeddings, queries, simhash
from tillcast.llm.common import components

from .conftest import EDGE, SF


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(grams))


def plain_components(n, linked, ids):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in linked(i):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low.get(root(i)) for i in range(n)]


def simhash_twin(rows):
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    comp = plain_components(len(rows), lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3), [i for i, _ in rows])
    return sorted(((str(i), f"{int(f):016x}", str(c)) for (i, _), f, c in zip(rows, fps, comp)))


def test_simhash_query_is_brute_force(spark, docs):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in queries.QUERIES["op2_simhash"](spark, SF).collect())
    assert got == simhash_twin(list(zip(docs.doc_id.tolist(), docs.text)))


def test_simhash_edge_rows(spark, edge):
    out = simhash.near_duplicates(edge)
    assert out.columns == ["doc_id", "fp", "component_id"]
    got = sorted((str(r[0]), f"{r[1] & (2**64 - 1):016x}", str(r[2])) for r in out.collect())
    assert got == simhash_twin([(i, t) for i, t, _ in EDGE])
    assert simhash.near_duplicates(edge.limit(0)).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i, _, c in simhash_twin([(i, t) for i, t, _ in EDGE]) if i == "None" or i == c)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    data = [(3, a), (5, a), (5, b), (5, None), (6, ""), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, a), (5, b), (5, None), (None, a)]))


@pytest.mark.parametrize("block", [7, 4096])
def test_simhash_links_join_all_near_fingerprints(spark, block):
    """Chains and large groups of near fingerprints, in one block and dealt to many."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c in centres:
        x = int(c)
        for _ in range(15):
            fps.add(x)
            x ^= sum(1 << int(b) for b in rng.choice(63, 3, replace=False))
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    edges = simhash.links(df, 3, 6, block)
    for r in edges.collect():
        assert bin(r.a ^ r.b).count("1") <= 3
    got = {r.node: r.component for r in components(edges).collect()}
    ids = fps.tolist()
    want = plain_components(len(fps), lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3), ids)
    assert [got.get(f, f) for f in ids] == want


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(2)
    nodes = rng.permutation(400).tolist()
    got = {r.node: r.component for r in components(
        spark.createDataFrame(list(zip(nodes[:-1], nodes[1:])), "a long, b long")).collect()}
    assert got == {n: 0 for n in range(400)}


def vector_twin(rows):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    def sound(v, label):
        return (label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
                and any(x != 0 for x in v))
    ok = [sound(v, lab) for _, v, lab in rows]
    unit = [np.array(v, float) / max(map(abs, v)) if s else None for (_, v, _), s in zip(rows, ok)]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]

    def linked(i):
        return [j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2]
                and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98]
    links = [linked(i) for i in range(len(rows))]
    comp = plain_components(len(rows), lambda i: links[i], [r[0] for r in rows])
    return [(r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, links, comp)]


def clusters(seed=3, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.standard_normal(dim)
            centre /= np.linalg.norm(centre)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((centre + rng.standard_normal(dim) * 0.03).astype(np.float32).astype(float).tolist() + [label])
    return [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [3, 1024])
def test_embedding_links_are_brute_force(spark, block):
    data = clusters()
    data += [(1000 + k, data[5][1], data[5][2]) for k in range(40)]        # copies of one vector
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: tuple(r) for r in embeddings.near_duplicates(df, block=block).collect()}
    want = {r[0]: r for r in vector_twin(data)}
    assert got.keys() == want.keys()
    links = sum(r[1] for r in want.values())
    assert links > 1000
    assert sum(r[1] for r in got.values()) >= 0.98 * links        # recall
    assert all(got[k][1] <= want[k][1] for k in want)             # no link below the threshold
    assert np.mean([got[k] == want[k] for k in want]) > 0.9


def test_embedding_query_on_the_table(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op4_embedding_dedup"](spark, SF).collect())
    assert got == sorted(vector_twin([(i, v.tolist(), k) for i, v, k in zip(e.vec_id.tolist(), e.embedding, e.label.tolist())]))


def test_embedding_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1),
            (6, [1.0, 0.0], None), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1),
            (10, [1.0, 0.0], 2), (11, [1e-30, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e300, 0.0], 1), (None, [5.0, 0.0], 1)]
    df = spark.createDataFrame([r + (0, 0.0) for r in data],
                               "vec_id long, embedding array<double>, label int, n_links int, weight double")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(df).collect())
    assert got == sorted((str(r[0]), r[1], str(r[2])) for r in vector_twin(data))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
