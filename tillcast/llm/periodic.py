"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends, at least ``max(least, times * q)`` long.  At
scale B (1, 2, 4, ...) the words are cut into aligned blocks of B.  A run with
B <= q < 2B and at least four periods holds a whole block and the copy of it q
words later, so the sum of squared differences of word numbers between the
block and the following window is 0 at distance q.  The sums for all B
distances come from one cyclic convolution of length 2B by number-theoretic
transforms, exact modulo primes whose product passes the largest possible sum.
Zeros seed the extension of the equal stretch both ways.

Two exact rules keep blocks out of the transforms.  A block can only recur
within 2B words if each of its words does.  And where a block and its whole
window lie inside a run already found, of a period p <= B, all zeros are
multiples of p and lead back to that run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import small_batches, text_bytes

#: Primes with a primitive root, one less than a multiple of 2**k each: (prime, root, k). Fixed values.
PRIMES = [(2013265921, 31, 27), (1811939329, 13, 26), (469762049, 3, 26)]
CELLS = 1 << 18          # array cells that one batch of transforms takes


# ------------------------------------------------------------ transforms

class Ntt:
    """Transforms of length ``n`` (a power of two) modulo a prime, along the last axis."""

    def __init__(self, n: int, prime: int, root: int):
        self.n, self.p = n, np.uint64(prime)
        self.forward = self._stages(pow(root, (prime - 1) // n, prime))
        self.backward = self._stages(pow(pow(root, (prime - 1) // n, prime), prime - 2, prime))
        self.scale = np.uint64(pow(n, prime - 2, prime))

    def _powers(self, w: int, count: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < count:
            step = np.uint64(pow(w, len(out), int(self.p)))
            out = np.concatenate((out, out * step % self.p))
        return out

    def _stages(self, w: int) -> list[np.ndarray]:
        out, half = [], self.n // 2
        while half:
            out.append(self._powers(w, half))
            w, half = w * w % int(self.p), half // 2
        return out

    def there(self, x: np.ndarray) -> np.ndarray:
        """Decimation in frequency: natural order in, bit-reversed order out."""
        shape = x.shape
        for w in self.forward:
            x = x.reshape(*shape[:-1], -1, 2, len(w))
            a, b = x[..., 0, :], x[..., 1, :]
            x = np.stack(((a + b) % self.p, (a + self.p - b) % self.p * w % self.p), axis=-2)
        return x.reshape(shape)

    def back(self, x: np.ndarray) -> np.ndarray:
        """The inverse: bit-reversed order in, natural order out."""
        shape = x.shape
        for w in reversed(self.backward):
            x = x.reshape(*shape[:-1], -1, 2, len(w))
            a, b = x[..., 0, :], x[..., 1, :] * w % self.p
            x = np.stack(((a + b) % self.p, (a + self.p - b) % self.p), axis=-2)
        return x.reshape(shape) * self.scale % self.p


def zero_distances(words: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block, distance)`` with ``size <= distance < 2 * size`` where a block recurs without a mismatch.

    ``words`` is long enough that every window (to ``(block + 4) * size``) exists.
    """
    hits = []
    step = max(1, CELLS // (2 * size))
    for start in range(0, len(blocks), step):
        at = blocks[start:start + step] * size
        view = words[at[:, None] + np.arange(3 * size)]
        numbers, view = np.unique(view, return_inverse=True)        # small numbers keep the sums small
        view = view.reshape(len(at), 3 * size)
        most, room, zero = size * (len(numbers) - 1) ** 2, 1, None
        for prime, root, _ in PRIMES:
            if room > most:
                break
            room *= prime
            none = _difference(view, size, prime, root) == 0
            zero = none if zero is None else zero & none
        if zero is None:                                            # one number only: all equal
            zero = np.ones((len(at), size), bool)
        elif room <= most:
            raise ValueError("blocks this long need another prime")
        row, shift = np.nonzero(zero)
        hits.append((blocks[start + row], shift + size))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*hits))


def _difference(view: np.ndarray, size: int, prime: int, root: int) -> np.ndarray:
    """Sums of squared differences, modulo ``prime``, of each row's block with the window at each distance."""
    p = np.uint64(prime)
    x = view.astype(np.uint64)
    block, window = x[:, :size], x[:, size:]
    ntt = Ntt(2 * size, prime, root)
    turned = np.zeros_like(window)                                  # reversed block: the product is a correlation
    turned[:, 0], turned[:, 2 * size - np.arange(1, size)] = block[:, 0], block[:, 1:]
    products = ntt.back(ntt.there(window) * ntt.there(turned) % p)[:, :size]
    squares = x * x % p
    total = np.cumsum(squares[:, size:], axis=1)
    before = np.concatenate((np.zeros((len(x), 1), np.uint64), total[:, :size - 1]), axis=1)
    sums = (total[:, size - 1:2 * size - 1] - before) % p + squares[:, :size].sum(axis=1, keepdims=True) % p
    return (sums + 2 * (p - products)) % p


# ------------------------------------------------------------ runs

def _reach(words: np.ndarray, place: int, period: int, step: int) -> int:
    """How many words from ``place`` on, in direction ``step``, equal the one a period later."""
    n, far = 0, 16
    while True:
        k = np.arange(n, n + far) * step + place
        k = k[(k >= 0) & (k + period < len(words))]
        differ = np.flatnonzero(words[k] != words[k + period])
        if len(differ):
            return n + int(differ[0])
        if len(k) < far:
            return n + len(k)
        n, far = n + far, far * 2


def find_runs(words: np.ndarray, recurs: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period.

    ``words`` are numbers; ``recurs[i]`` is the distance to the next place of
    the same word, a number past the end where there is none.  ``times`` is 4
    or more: below that a run need not hold a block and its copy.
    """
    if times < 4:
        raise ValueError("runs need four periods")
    n, size = len(words), 1
    found: dict[tuple[int, int], int] = {}
    long: list[tuple[int, int, int]] = []
    far = recurs
    while times * size <= n:
        blocks = n // size
        if size > 1:
            far = np.maximum(far[0:2 * blocks:2], far[1:2 * blocks:2])
        active = np.flatnonzero(far[:blocks] < 2 * size)
        long = [(s, e, p) for s, e, p in long if e - s >= 2 * size]
        for s, e, p in long:                                        # whole window inside a known run
            active = active[(active * size < s) | (active * size + 3 * size - 1 > e)]
        if len(active):
            padded = words if (active[-1] + 3) * size <= n else np.concatenate((words, np.full(3 * size, -1, words.dtype)))
            block, shift = zero_distances(padded, active, size)
            for s, e, p in long:                                    # a multiple of a known run's period inside it
                lo, hi = np.searchsorted(block, [-(-s // size), e // size])
                inner = slice(lo, hi)
                gone = (shift[inner] % p == 0) & ((block[inner] + 1) * size + shift[inner] <= e)
                block, shift = np.delete(block, lo + np.flatnonzero(gone)), np.delete(shift, lo + np.flatnonzero(gone))
            order = np.lexsort((block, shift))
            block, shift = block[order], shift[order]
            # neighbouring blocks at one distance are one stretch
            new = np.ones(len(block), bool)
            new[1:] = (shift[1:] != shift[:-1]) | (block[1:] != block[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(block)) - 1 if len(block) else first
            for b0, b1, q in zip(block[first].tolist(), block[last].tolist(), shift[first].tolist()):
                left = b0 * size
                start = left - _reach(words, left - 1, q, -1)
                right = (b1 + 1) * size
                end = right + _reach(words, right, q, 1) + q
                if end - start >= max(least, times * q) and (start, end) not in found:
                    found[start, end] = q
                    long.append((start, end, q))
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def next_places(words: np.ndarray) -> np.ndarray:
    """Distance from each word to the next place of the same number (a number past the end if none)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    out = np.full(n, n + 1, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all texts' words as numbers with a number of its own after each text, and text starts."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts + 1)))
    coded = pa.array([w for words in split for w in words], pa.large_binary()).dictionary_encode()
    numbers = np.empty(starts[-1], np.int64)
    inside = np.ones(len(numbers), bool)
    inside[starts[1:] - 1] = False
    numbers[inside] = coded.indices.to_numpy(zero_copy_only=False)
    numbers[~inside] = len(coded.dictionary) + np.arange(len(texts))
    return split, numbers, starts


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``(doc_id, n_words, runs, text)``, one row per input row.

    Words are what ASCII white space parts, numbered from 0; ``runs`` are all
    runs of the whole text by start and period; ``text`` is the words without
    those that lie in some run after its first period, joined by single spaces.
    Null and empty texts have no words, no runs and an empty text.  Each row is
    judged by its own text, whatever its doc_id; an empty table gives no rows.
    Nothing is shuffled, and a task holds one small batch of texts at a time.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in small_batches(batches, "text"):
            split, numbers, starts = _numbered(text_bytes(batch.column(1)))
            found = find_runs(numbers, next_places(numbers), least, times)
            runs: list[list] = [[] for _ in split]
            edge = np.zeros(len(numbers) + 1, np.int64)
            where = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1
            for i, (s, length, q) in zip(where.tolist(), found):
                runs[i].append((s - int(starts[i]), length, q))
                edge[s + q] += 1
                edge[s + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            texts = []
            for i, words in enumerate(split):
                if runs[i]:
                    words = [w for w, g in zip(words, gone[starts[i]:].tolist()) if not g]
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], run),
                 pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "text"])

    return base.mapInArrow(work, f"doc_id long, n_words long, runs {RUNS}, text string")
