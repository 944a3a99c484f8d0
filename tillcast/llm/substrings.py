"""Substring dedup with a compressed FM-index for each shard.

The words of every document are cut into segments by content: a window of
``window`` words belongs to the smallest hash among its 8-word grams (its
anchor), and neighbouring windows of one anchor are a segment.  Equal windows
have equal anchors, so a shard that holds all segments of its anchors can be
searched by itself.  Segments that stand in several documents are kept once,
with their smallest doc_id, and anchors of a single document are left out.

A shard is a batch of anchors.  It is indexed by a Burrows-Wheeler transform in
a wavelet matrix with sampled ranks, and its segments are streamed through it:
backward search gives the matching statistics (how far back from each word the
text stands somewhere else too), and places that reach ``window`` words are
reported with the smallest doc_id of the interval.  An anchor with more than
``most_segments`` segments is not indexed; its windows are met by their
128-bit content hashes, merged before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import small_batches, text_bytes, whole_groups, written

GRAM = 8
MOST_WINDOWS = 1024      # a segment is cut after so many windows (repetitive text has one anchor for long)


# ------------------------------------------------------------ segments

def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest mixed hash of its grams."""
    gram = min(GRAM, window)
    n = len(words) - gram + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
        h = _mixed(h)
    wide, reach = window - gram + 1, 1
    while 2 * reach <= wide:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[:len(h) - (wide - reach)], h[wide - reach:])


def _segments(window: int):
    names = ["anchor", "seg_a", "seg_b", "doc_id", "text_key", "start", "n_windows"]

    def work(batches):
        for batch in small_batches(batches, "text"):
            out = [[] for _ in names]
            keys = batch.column(2).to_pylist()
            for doc_id, text, key in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), keys):
                words = word_hashes(text)
                if len(words) < window:
                    continue
                anchor = anchors(words, window)
                cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                starts = np.concatenate(([0], cuts))
                ends = np.concatenate((cuts, [len(anchor)]))
                if (ends - starts).max() > MOST_WINDOWS:
                    starts = np.concatenate([np.arange(a, b, MOST_WINDOWS) for a, b in zip(starts, ends)])
                    ends = np.concatenate((starts[1:], [len(anchor)]))
                data = words.tobytes()
                digest = b"".join([xxhash.xxh3_128_digest(data[8 * a:8 * (b + window - 1)])
                                   for a, b in zip(starts.tolist(), ends.tolist())])
                pair = np.frombuffer(digest, "<i8").reshape(-1, 2)
                n = len(starts)
                for column, value in zip(out, (anchor[starts].view(np.int64), pair[:, 0], pair[:, 1],
                                               np.full(n, doc_id), np.full(n, key), starts, ends - starts)):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int32 if k > 4 else np.int64)) for k, c in enumerate(out)],
                    names=names)
    return work


# ------------------------------------------------------------ the index

class FmIndex:
    """FM-index of a text of symbols 1..sigma; 0 parts the texts.

    The order of suffixes is settled on their first 64 symbols or more, which is
    enough for patterns of up to 64 symbols.
    """

    def __init__(self, text: np.ndarray, reach: int):
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while step < reach:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            _, rank = np.unique(rank * (after.max() + 1) + after, return_inverse=True)
            step *= 2
        self.suffix = np.argsort(rank, kind="stable")
        last = text[self.suffix - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.levels = []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int64)))
            zeros = n - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        # where each symbol's own stretch begins in the last level
        symbols = np.arange(len(self.first) - 1)
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = at >> 6
            below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of ``symbol`` followed by what the intervals stood for."""
        both = self._down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        start = self.first[symbol] - self.base[symbol]
        return start + both[:len(symbol)], start + both[len(symbol):]


def matched(text: np.ndarray, ends: np.ndarray, window: int):
    """Windows that end at ``ends`` and stand elsewhere too: their numbers and intervals.

    Backward search from each end at once; a window is let go when its interval
    holds its own place alone, so its matching statistic is known to be under
    ``window``.
    """
    index = FmIndex(text, window)
    alive = np.arange(len(ends))
    symbol = text[ends]
    low, high = index.first[symbol], index.first[symbol + 1]
    for back in range(1, window):
        several = high - low > 1
        alive, low, high = alive[several], low[several], high[several]
        if not len(alive):
            break
        low, high = index.extend(text[ends[alive] - back], low, high)
    several = high - low > 1
    return index, alive[several], low[several], high[several]


def _searched(window: int):
    """Stretches of windows of a shard's segments with the smallest doc_id that holds them."""
    def work(batches):
        for table in whole_groups(batches, ["anchor"], 1024):
            lists = table.column("words").combine_chunks()
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = np.asarray(lists.flatten())
            low_doc, high_doc = table.column("low").to_numpy(), table.column("high").to_numpy()
            _, symbols = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) + owner + 1             # a 0 before each segment
            text = np.zeros(len(flat) + len(sizes) + 1, np.int64)
            text[place] = symbols + 1
            of = np.full(len(text), np.iinfo(np.int64).max)      # the smallest doc_id at each place
            of[place] = low_doc[owner]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            k = np.arange(len(flat)) - first[owner]              # word number in the segment
            is_end = k >= window - 1
            ends, segment, number = place[is_end], owner[is_end], k[is_end] - (window - 1)
            index, several, low, high = matched(text, ends, window)
            smallest = low_doc[segment].copy()
            if len(several):
                # equal intervals are equal windows: take the smallest doc_id once for each
                starts, back = np.unique(low, return_inverse=True)
                stops = np.zeros(len(starts), np.int64)
                stops[back] = high
                docs = np.append(of[index.suffix], np.iinfo(np.int64).max)
                least = np.minimum.reduceat(docs, np.stack((starts, stops), axis=1).ravel())[::2]
                smallest[several] = np.minimum(smallest[several], least[back])
            change = np.flatnonzero((segment[1:] != segment[:-1]) | (smallest[1:] != smallest[:-1])) + 1
            a = np.concatenate(([0], change))
            b = np.concatenate((change, [len(segment)])) - 1
            of_use = smallest[a] < high_doc[segment[a]]
            a, b = a[of_use], b[of_use]
            if len(a):
                rows = segment[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (table.column("seg_a").to_numpy()[rows], table.column("seg_b").to_numpy()[rows],
                                           number[a].astype(np.int32), number[b].astype(np.int32), smallest[a])],
                    names=["seg_a", "seg_b", "k_from", "k_to", "min_doc"])
    return work


FOUND = "seg_a long, seg_b long, k_from int, k_to int, min_doc long"


# ------------------------------------------------------------ the operator

def _shared_segments(segments: DataFrame) -> DataFrame:
    """The segments whose anchor stands in two documents or more; no other can repeat in a later document."""
    anchors_of = segments.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"))
    return segments.join(anchors_of.filter("low <> top").select("anchor"), "anchor", "left_semi")


def _live_segments(shared: DataFrame, most_segments: int) -> DataFrame:
    """Distinct segments of shared anchors, and whether the anchor is hot."""
    place = F.struct("doc_id", "text_key", "start")
    distinct = written(shared.groupBy("seg_a", "seg_b").agg(
        F.min("anchor").alias("anchor"), F.min("n_windows").alias("n_windows"), F.min(place).alias("place"),
        F.max("doc_id").alias("high")), "distinct")
    live = distinct.groupBy("anchor").agg((F.count(F.lit(1)) > most_segments).alias("hot"))
    return distinct.join(live, "anchor").select(
        "anchor", "seg_a", "seg_b", "hot", "high", "n_windows", F.col("place.doc_id").alias("doc_id"),
        F.col("place.text_key").alias("text_key"), F.col("place.start").alias("start"))


def _with_words(live: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The live segments with the hashes of their words, cut from the document that has them first."""
    wanted = live.groupBy("doc_id", "text_key").agg(F.collect_list(
        F.struct("start", "n_windows", "anchor", "seg_a", "seg_b", "high", "hot")).alias("wanted"))
    source = docs.dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"]).select("doc_id", "text", "wanted")

    def work(batches):
        for batch in small_batches(batches, "text", 4 << 20):
            wanted = batch.column(2)
            fields = [np.asarray(wanted.flatten().field(k)) for k in range(5)]
            bounds = np.concatenate(([0], np.cumsum(np.asarray(wanted.value_lengths()))))
            words, sizes = [], []
            for k, text in enumerate(text_bytes(batch.column(1))):
                own = word_hashes(text).view(np.int64)
                for r in range(bounds[k], bounds[k + 1]):
                    a = fields[0][r]
                    words.append(own[a:a + fields[1][r] + window - 1])
                    sizes.append(len(words[-1]))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = wanted.flatten()
            yield pa.RecordBatch.from_arrays(
                [flat.field(2), flat.field(3), flat.field(4),
                 pa.array(np.repeat(np.asarray(batch.column(0)), np.diff(bounds))), flat.field(5), flat.field(6),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words)))],
                names=["anchor", "seg_a", "seg_b", "low", "high", "hot", "words"])

    return source.mapInArrow(work, "anchor long, seg_a long, seg_b long, low long, high long, hot boolean, words array<long>")


def _met_by_hash(segments: DataFrame, window: int) -> DataFrame:
    """The same stretches for segments of hot anchors: windows met by their 128-bit hashes."""
    def work(batches):
        for batch in batches:
            lists = batch.column(3)
            if not batch.num_rows:
                continue
            sizes = np.asarray(lists.value_lengths())
            data = np.asarray(lists.flatten()).tobytes()
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            many = sizes - window + 1
            rows = np.repeat(np.arange(len(sizes)), many)
            k = np.arange(len(rows)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
            at = ((first[rows] + k) * 8).tolist()
            digest = b"".join([xxhash.xxh3_128_digest(data[a:a + 8 * window]) for a in at])
            pair = np.frombuffer(digest, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows)) for c in range(3)]
                + [pa.array(k.astype(np.int32)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                names=["seg_a", "seg_b", "low", "k", "win_a", "win_b"])

    each = written(segments.select("seg_a", "seg_b", "low", "words").mapInArrow(
        work, "seg_a long, seg_b long, low long, k int, win_a long, win_b long"), "windows")
    least = each.groupBy("win_a", "win_b").agg(F.min("low").alias("min_doc"))
    return each.join(least, ["win_a", "win_b"]).select(
        "seg_a", "seg_b", F.col("k").alias("k_from"), F.col("k").alias("k_to"), "min_doc")


def remove_repeats(docs: DataFrame, window: int = 50, most_segments: int = 2000) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``, one row per input row.

    Words are what ASCII white space parts, unchanged.  A word goes if it lies in
    a window of ``window`` words whose sequence also starts in a document with a
    smaller doc_id, judged on the input; ``text`` is the rest, joined by single
    spaces.  Texts that are null, empty or shorter than a window lose nothing
    (null counts as empty).  Rows with a null doc_id lose nothing and are no
    earlier place for others; rows that share a doc_id are judged each, and
    never against one another.  An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_key", F.xxhash64("text"))
    known = base.filter("doc_id is not null")
    segments = written(known.mapInArrow(
        _segments(window),
        "anchor long, seg_a long, seg_b long, doc_id long, text_key long, start int, n_windows int"), "segments")
    shared = written(_shared_segments(segments), "shared")
    words = written(_with_words(_live_segments(shared, most_segments), known, window), "words")
    shards = words.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    found = shards.mapInArrow(_searched(window), FOUND).unionByName(_met_by_hash(words.filter("hot"), window))
    marks = (shared.join(found, ["seg_a", "seg_b"]).filter("doc_id > min_doc")
             .groupBy("doc_id", "text_key").agg(F.collect_set(
                 F.struct((F.col("start") + F.col("k_from")).alias("first"),
                          (F.col("start") + F.col("k_to") + window).alias("past"))).alias("gone")))
    marked = base.join(marks, ["doc_id", "text_key"], "left").select("doc_id", "text", "gone")

    def cut(batches):
        for batch in small_batches(batches, "text"):
            gone = batch.column(2).to_pylist()
            n_words, n_gone, kept = [], [], []
            for text, stretches in zip(text_bytes(batch.column(1)), gone):
                words = text.split()
                n_words.append(len(words))
                if stretches:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in stretches], 1)
                    np.add.at(edge, [s["past"] for s in stretches], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_gone.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"])

    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
