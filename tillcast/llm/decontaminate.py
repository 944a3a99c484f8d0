"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Texts and benchmark items are word sequences.  Runs of ``least`` words that a
text shares with an item are seeds; a text whose seeds could cover enough of an
item is tiled against it: the longest common runs that do not overlap tiles
already marked become tiles, longest first, down to ``least`` words.  The share
of the item's words under tiles is its coverage, so passages that were cut up
and put in another order are found too.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import rows_by_text, small_batches

WORD = re.compile(r"\w+")
_BASE = np.uint64(1_000_003)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``n`` ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _BASE + ids[k:k + len(h)].astype(np.uint64)
    return h


def _free(mask: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of ``n`` places is free as a whole."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[n:] - total[:-n] == n


class _Runs:
    """How far two places of ``text`` and ``item`` agree, by hashes of their prefixes."""

    def __init__(self, text: np.ndarray, item: np.ndarray):
        self.power = np.cumprod(np.append(np.uint64(1), np.full(max(len(text), len(item)), _BASE)), dtype=np.uint64)
        self.text, self.item = (np.append(np.uint64(0), np.cumsum(ids.astype(np.uint64) * self.power[:len(ids)], dtype=np.uint64))
                                for ids in (text, item))

    def agree(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ((self.text[a + n] - self.text[a]) * self.power[b]) == ((self.item[b + n] - self.item[b]) * self.power[a])


def _room(free: np.ndarray) -> np.ndarray:
    """For each place, how many places from it on are free."""
    taken = np.append(np.flatnonzero(~free), len(free))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def tiles(text: np.ndarray, item: np.ndarray, least: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(text place, item place, length)`` of the tiles.

    Ids are positive; 0 matches nothing.  Running Karp-Rabin: runs of the search
    length are met by hash, compared and extended; the search length rises to a
    match more than twice as long and falls to ``least`` in the end.  Lengths
    are found by hash, and each tile is compared word by word before it counts;
    should one differ, all is done again with lengths found by words.
    """
    by_hash = _tiled(text, item, least, _Runs(text, item))
    return _tiled(text, item, least, None) if by_hash is None else by_hash


def _tiled(text, item, least, runs):
    text_free, item_free = text > 0, item > 0
    found: list[tuple[int, int, int]] = []
    length = max(least, min(20, len(item)))
    while True:
        matches, longest = _matches(text, item, text_free, item_free, length, runs)
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for n, a, b in matches.tolist():
            # tiles marked in this round are no shorter, so one that overlaps holds an end of this match
            if text_free[a] and text_free[a + n - 1] and item_free[b] and item_free[b + n - 1]:
                if runs and not np.array_equal(text[a:a + n], item[b:b + n]):
                    return None
                text_free[a:a + n] = item_free[b:b + n] = False
                found.append((a, b, n))
                marked = True
        if marked:
            continue                     # parts of matches that lost places may still be long enough
        if length == least:
            return found
        length = max(least, length // 2)


def _matches(text, item, text_free, item_free, length, runs, most_pairs: int = 1 << 20):
    """Maximal common free runs of ``length`` or more as rows ``(n, a, b)``,
    longest first, then by place, and the greatest n.

    Only the starts of such runs are paired: places of equal run hashes whose
    words before differ (or are not free).  Item places are sorted by hash and
    word before, so the places with the same word before are one stretch that is
    left out, and a repeated word costs no pair for every two of its places.
    """
    none = np.zeros((0, 3), np.int64), 0
    if len(item) < length or len(text) < length:
        return none
    places = np.flatnonzero(_free(item_free, length))
    starts = np.flatnonzero(_free(text_free, length))
    if not len(places) or not len(starts):
        return none
    hashes, group = np.unique(rolling(item, length)[places], return_inverse=True)
    text_hash = rolling(text, length)[starts]
    text_group = np.minimum(np.searchsorted(hashes, text_hash), len(hashes) - 1)
    near = hashes[text_group] == text_hash
    starts, text_group = starts[near], text_group[near]
    # the free word before a place, 0 where there is none (such places start a run with any other)
    item_before = np.where(np.append(False, item_free[:-1]), np.append(0, item[:-1]), 0)[places]
    text_before = np.where(np.append(False, text_free[:-1]), np.append(0, text[:-1]), 0)[starts]
    wide = int(max(item.max(), text.max())) + 1
    key = group.astype(np.int64) * wide + item_before
    order = np.argsort(key, kind="stable")
    key, places = key[order], places[order]
    at = text_group.astype(np.int64) * wide
    low, high = np.searchsorted(key, at), np.searchsorted(key, at + wide)
    same_low = np.where(text_before > 0, np.searchsorted(key, at + text_before), high)
    same_high = np.where(text_before > 0, np.searchsorted(key, at + text_before, "right"), high)
    begins, ends = np.concatenate([low, same_high]), np.concatenate([same_low, high])
    starts = np.concatenate([starts, starts])
    some = ends > begins
    begins, ends, starts = begins[some], ends[some], starts[some]
    text_room, item_room = _room(text_free), _room(item_free)
    found, total = [], np.cumsum(ends - begins)
    cut = 0
    while cut < len(starts):                 # about most_pairs pairs at a time
        done = total[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(total, done + most_pairs, "right")))
        sizes = ends[cut:stop] - begins[cut:stop]
        a = np.repeat(starts[cut:stop], sizes)
        b = places[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins[cut:stop], sizes)]
        n = _agreement(text, item, a, b, np.minimum(text_room[a], item_room[b]), runs)
        found.append(np.stack([n, a, b], axis=1)[n >= length])
        cut = stop
    rows = np.concatenate(found) if found else none[0]
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))]
    return rows, int(rows[0, 0])


def _agreement(text, item, a, b, room, runs):
    """Length of the common run at each pair of places, at most ``room``: by halving with ``runs``, else word by word."""
    if runs:
        least, most = np.zeros(len(a), np.int64), room.astype(np.int64)
        while (least < most).any():
            half = (least + most + 1) // 2
            good = runs.agree(a, b, half)
            least, most = np.where(good, half, least), np.where(good, most, half - 1)
        return least
    n, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(alive):
        alive = alive[n[alive] < room[alive]]
        alive = alive[text[a[alive] + n[alive]] == item[b[alive] + n[alive]]]
        n[alive] += 1
    return n


class _Seeds:
    """Seeds of a block of benchmark items: their words, runs and where the runs stand."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.vocabulary, self.items = least, {}, []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids) < least:
                continue
            h = rolling(ids, least)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, ids))
        empty = [np.zeros(0, np.int64)]
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)
        self.hash = h[order]
        self.owner = np.concatenate(owners or empty)[order]
        self.place = np.concatenate(places or empty)[order]

    def found_in(self, text: str | None, coverage: float):
        """``(item_id, coverage, tiles, longest tile)`` of the items that the text covers."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        if len(ids) < self.least or not len(self.hash):
            return
        at = np.flatnonzero(_free(ids > 0, self.least))
        if not len(at):
            return
        h = rolling(ids, self.least)[at]
        low = np.searchsorted(self.hash, h)
        hit = self.hash[np.minimum(low, len(self.hash) - 1)] == h
        at, h = at[hit], h[hit]
        if not len(at):
            return
        seeds = np.unique(h)
        first, last = np.searchsorted(self.hash, seeds), np.searchsorted(self.hash, seeds, "right")
        posting = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
        owner, place = self.owner[posting], self.place[posting]
        order = np.argsort(owner, kind="stable")
        owners, begins, counts = np.unique(owner[order], return_index=True, return_counts=True)
        # an item whose seeds could not cover it even side by side is not looked at
        enough = counts * self.least >= coverage * self.lengths[owners]
        for k, begin, count in zip(owners[enough].tolist(), begins[enough].tolist(), counts[enough].tolist()):
            item_id, item = self.items[k]
            mine = order[begin:begin + count]
            could = np.zeros(len(item) + self.least, bool)
            for d in range(self.least):
                could[place[mine] + d] = True
            if could.sum() < coverage * len(item):
                continue
            # only the parts of the text under this item's seeds can hold tiles
            own = at[np.isin(h, self.hash[posting[mine]])]
            under = np.zeros(len(ids) + 1, bool)
            for d in range(self.least):
                under[own + d] = True
            part = np.where(under, np.append(ids, 0), 0)
            part = part[under | np.append(False, under[:-1])]       # one 0 between parts
            found = tiles(part, item, self.least)
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(item):
                yield item_id, covered / len(item), len(found), max(n for _, _, n in found)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8,
          block_chars: int = 16_000_000) -> DataFrame:
    """``(doc_id, item_id, coverage, n_tiles, longest_tile)`` of documents that hold an item.

    Words are runs of letters, digits and underscores, compared in lower case,
    over whole texts.  An item is held if tiles of ``least`` (five) words or more
    cover at least ``coverage`` of its words; items of fewer words than that
    have no seeds and are never held.  The benchmark is dealt to blocks of about
    ``block_chars`` characters; each block is sent to all tasks and met with all
    documents, so what is sent is bounded however long the benchmark is.
    Documents are not shuffled.  Null and empty texts hold nothing; rows with a
    null or repeated doc_id are judged like any other and give a row each.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"

    def met(held) -> DataFrame:
        def work(batches):
            seeds = _Seeds(held.value, least)
            for batch in small_batches(batches, "text"):
                rows = [(doc_id, *found)
                        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for found in seeds.found_in(text, coverage)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])
        return base.mapInArrow(work, schema)

    return reduce(DataFrame.union, [met(held) for held in _blocks(benchmark, block_chars)])


def _blocks(benchmark: DataFrame, block_chars: int):
    """Broadcast blocks of the benchmark of about ``block_chars`` characters each."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = items.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}"))
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("item_id", "text").collect()])


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8,
          block_chars: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (see ``leaks``).

    Each row is judged by its own text, so rows with a null or repeated doc_id
    go or stay by themselves, and nothing is shuffled or joined.  A block of the
    benchmark is one pass over the rows left; a row that one block drops is not met with the next.
    """
    def free_of(held):
        def judge():
            seeds = _Seeds(held.value, least)
            return lambda texts: [next(seeds.found_in(t, coverage), None) is None for t in texts.to_pylist()]
        return judge

    return reduce(lambda left, held: rows_by_text(left, free_of(held)), _blocks(benchmark, block_chars), docs)
