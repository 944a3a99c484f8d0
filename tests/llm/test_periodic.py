"""Periodic runs against brute force, on small alphabets and on the table."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from tillcast.llm import periodic, queries

from .conftest import EDGE, SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def runs_twin(w, least=6, times=4):
    """Every maximal stretch of every period, kept where no smaller period holds it."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def of(words):
    x = np.array(words, np.int64)
    return periodic.find_runs(x, periodic.next_places(x))


def test_transform_is_a_cyclic_convolution():
    rng = np.random.default_rng(1)
    for prime, root, k in periodic.PRIMES:
        assert (prime - 1) % (1 << k) == 0
        for n in (2, 4, 16, 64):
            a, b = rng.integers(0, prime, (2, 3, n), dtype=np.uint64)
            ntt = periodic.Ntt(n, prime, root)
            got = ntt.back(ntt.there(a) * ntt.there(b) % np.uint64(prime))
            want = [[sum(int(x[i]) * int(y[(j - i) % n]) for i in range(n)) % prime for j in range(n)] for x, y in zip(a, b)]
            assert got.tolist() == want


def test_zero_distances_are_exact_with_large_numbers():
    """Numbers whose squares pass one prime: several primes decide."""
    rng = np.random.default_rng(5)
    words = rng.permutation(200_000).astype(np.int64)
    words[40_000:100_000] = words[np.arange(60_000) % 5000 + 40_000]
    block, shift = periodic.zero_distances(np.concatenate((words, np.full(20_000, -1))), np.arange(9, 20), 4096)
    assert set(shift.tolist()) == {5000}
    assert block.tolist() == [b for b in range(9, 20) if b * 4096 >= 40_000 and (b + 1) * 4096 + 5000 <= 100_000]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_are_brute_force(letters):
    rng = np.random.default_rng(letters)
    for trial in range(150):
        w = rng.integers(0, letters, int(rng.integers(0, 90))).tolist()
        if trial % 2:
            unit = rng.integers(0, letters, int(rng.integers(1, 20))).tolist()
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = (unit * 9)[:int(rng.integers(1, 9 * len(unit) + 1))]
        if trial % 5 == 0:
            unit = [0, 0, 0, 0, 0, 0, 0, 1][:int(rng.integers(2, 9))]
            w += unit * 5 + [1] + unit * 6
        assert of(w) == runs_twin(w), w


def test_runs_inside_runs():
    unit = [1, 2] * 6 + [3] * 7 + [4]
    w = [9] + unit * 5 + unit[:4] + [8] + [5, 6, 7] * 40
    assert of(w) == runs_twin(w) and len(of(w)) > 8


def test_long_repetitive_texts_are_not_quadratic():
    began = time.time()
    assert of([7] * 1_000_000) == [(0, 1_000_000, 1)]
    period = np.random.default_rng(0).integers(0, 50_000, 60_000)
    w = np.concatenate((np.tile(period, 5), np.tile(period[:31], 3000)))
    assert (0, 300_031, 60_000) in of(w) or (0, 300_000, 60_000) in of(w)
    assert time.time() - began < 30


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_twin(doc_id, text):
    w = planted(doc_id, WORDS.findall(text or ""))
    runs = runs_twin(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0]
        best = (s, length, q, 1000 * length // q)
    return (str(doc_id), len(runs), *map(str, best),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def got_rows(df):
    return sorted((str(r.doc_id), r.n_runs, str(r.start), str(r.length), str(r.period), str(r.exponent_milli),
                   r.runs_sha256, r.collapsed_sha256) for r in df.collect())


def test_query_is_brute_force(spark, docs):
    got = got_rows(queries.QUERIES["op11_periodic_runs"](spark, SF))
    want = sorted(periodic_twin(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text) if len(t) < 9000)
    assert len(got) == len(docs) and set(want) <= set(got)
    assert sum(r[1] > 0 for r in want) > 5


def test_edge_rows(spark, edge):
    rows = [r for r in EDGE if r[0] != 8]
    small = edge.filter("doc_id is null or doc_id <> 8")
    got = got_rows(queries.periodic_digest(small, plant=False))
    want = []
    for doc_id, text, _ in rows:
        if doc_id == 7:                                     # 30,000 equal words
            want.append(("7", 1, "0", "30000", "1", "30000000", hashlib.sha256(b"0,30000,1\n").hexdigest(),
                         hashlib.sha256(b"w").hexdigest()))
        else:
            t = periodic_twin(None, text)
            want.append((str(doc_id), *t[1:]))
    assert got == sorted(want)
    assert queries.periodic_digest(edge.limit(0)).count() == 0
    out = periodic.collapse(edge).filter("doc_id = 8").collect()
    assert out[0].n_words == 40_000


def test_planting_in_sql(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 60)) + ("\n" if i % 3 else " x")) for i in range(400)] + [(None, "a b")]
    df = queries.planted_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, tuple(WORDS.findall(r.text))) for r in df.collect()}
    assert got == {(i, tuple(planted(i, WORDS.findall(t)))) for i, t in rows}
