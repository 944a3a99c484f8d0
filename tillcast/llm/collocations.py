"""Phrase collocations counted in quotient filters.

Texts are dealt to chunks of one language, each with a dictionary of its own.
Chunk words are counted over the corpus; those frequent enough to stand in a
phrase get a number, and each chunk learns the numbers of its own words by a
join of its dictionary (no vocabulary is sent to all tasks).  The word numbers
of an n-gram are packed side by side in two halves and permuted invertibly (a
Feistel network), which spreads neighbouring n-grams evenly.  A counting
quotient filter holds the permuted keys of a chunk in order: the leading bits
(the quotient) as unary run lengths, the other bits (the full remainder) and a
counter each, so it is lossless and compact.  The first bits of the quotient
deal the filters to tasks; each task merges the sorted filters of one stretch,
adds the counters, and turns the keys that are frequent back into word numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import text_bytes, written

LONGEST = 4                      # words of a phrase
ENDS = b".,;:!?\n\x0b\x0c\r"     # bytes that end a piece
_SPLIT = bytes(ord(".") if b in ENDS else b for b in range(256))
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
        np.uint64(0xD6E8FEB86659FD93)]


# ------------------------------------------------------------ packed n-grams

class Packing:
    """n-grams of ``n`` numbers of ``bits`` bits (32 at most) as permuted pairs of halves."""

    def __init__(self, n: int, bits: int):
        if bits > 32:
            raise ValueError("word numbers of 32 bits at most")
        self.n, self.bits = n, bits
        self.left = n * bits // 2
        self.right = n * bits - self.left

    def pack(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the numbers standing side by side, first number leading."""
        size = len(numbers[0])
        left, right = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        low = self.n * self.bits
        for x in numbers:
            low -= self.bits                                    # place of this number's last bit
            x = x.astype(np.uint64)
            if low >= self.right:
                left |= x << np.uint64(low - self.right)
            elif low + self.bits <= self.right:
                right |= x << np.uint64(low)
            else:                                               # across the halves
                left |= x >> np.uint64(self.right - low)
                right |= (x << np.uint64(low)) & _mask(self.right)
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        out, low = [], self.n * self.bits
        for _ in range(self.n):
            low -= self.bits
            if low >= self.right:
                x = left >> np.uint64(low - self.right)
            elif low + self.bits <= self.right:
                x = right >> np.uint64(low)
            else:
                x = (left << np.uint64(self.right - low)) | (right >> np.uint64(low))
            out.append((x & _mask(self.bits)).astype(np.int64))
        return out

    def permute(self, left, right):
        for k, m in enumerate(_MIX):
            if k % 2:
                left = left ^ _round(right, m, self.left)
            else:
                right = right ^ _round(left, m, self.right)
        return left, right

    def restore(self, left, right):
        for k, m in reversed(list(enumerate(_MIX))):
            if k % 2:
                left = left ^ _round(right, m, self.left)
            else:
                right = right ^ _round(left, m, self.right)
        return left, right

    def summed(self, left, right, count=None):
        """Equal keys as one, in the order of the keys; counts are added."""
        whole = self.left + self.right <= 64
        if whole:
            keys = (left << np.uint64(self.right)) | right
            if count is None:
                keys = np.sort(keys)
            else:
                order = np.argsort(keys, kind="stable")
                keys, count = keys[order], count[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            left, right = keys >> np.uint64(self.right), keys & _mask(self.right)
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            count = None if count is None else count[order]
            new = np.ones(len(left), bool)
            new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(new)
        if count is None:
            total = np.diff(np.append(first, len(new)))
        else:
            total = np.add.reduceat(count, first) if len(first) else count
        return left[first], right[first], total.astype(np.int64)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _round(x: np.ndarray, m: np.uint64, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = (x + m) * m
        y ^= y >> np.uint64(29)
        y *= _MIX[0]
    return y >> np.uint64(64 - bits)


# ------------------------------------------------------------ filters

def encode(left: np.ndarray, right: np.ndarray, count: np.ndarray, packing: Packing, shard: int) -> bytes:
    """A counting quotient filter of sorted keys that share their first ``shard`` bits.

    Layout: number of keys, number of quotient bits, unary run lengths (a one
    for each key, a zero to end each quotient), remainders in whole bytes of the
    two halves, counters of one byte, and wide counters for those at 255.
    """
    room = packing.left - shard
    q = min(room, max(1, int(len(left)).bit_length() - 1)) if room else 0
    rest = packing.left - shard - q
    inner = left & _mask(packing.left - shard)
    slot = (inner >> np.uint64(rest)).astype(np.int64)
    unary = np.zeros(len(left) + (1 << q), np.uint8)
    unary[np.arange(len(left)) + slot] = 1
    small = np.minimum(count, 255).astype(np.uint8)
    return b"".join([
        np.array([len(left), q], "<i8").tobytes(), np.packbits(unary).tobytes(),
        _to_bytes(inner & _mask(rest), rest), _to_bytes(right, packing.right),
        small.tobytes(), count[small == 255].astype("<i8").tobytes()])


def decode(data: bytes, packing: Packing, shard: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted halves and counts of a filter whose keys start with the bits of ``prefix``."""
    n, q = np.frombuffer(data, "<i8", 2).tolist()
    at, size = 16, (n + (1 << q) + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << q))
    slot = (np.flatnonzero(unary) - np.arange(n)).astype(np.uint64)
    at += size
    rest = packing.left - shard - q
    low, at = _from_bytes(data, at, n, rest)
    right, at = _from_bytes(data, at, n, packing.right)
    count = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    count[count == 255] = np.frombuffer(data, "<i8", offset=at + n)
    left = (np.uint64(prefix) << np.uint64(packing.left - shard)) | (slot << np.uint64(rest)) | low
    return left, right, count


def _to_bytes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].tobytes()


def _from_bytes(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    wide = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
    return out.view("<u8").ravel().astype(np.uint64), at + n * wide


# ------------------------------------------------------------ chunks

def _chunks(chunk_bytes: int):
    """Word numbers of texts by language, in the numbers of the chunk's own dictionary; -1 ends a piece."""
    def flush(held: dict[str, list[bytes]], chunk: int):
        for lang, texts in held.items():
            tokens = b" . ".join(texts).lower().translate(_SPLIT).replace(b".", b" . ").split()
            coded = pa.array(tokens, pa.binary()).dictionary_encode()
            words = coded.dictionary.to_pylist()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            if b"." in words:
                end = words.index(b".")
                words[end] = words[-1]                          # the last word takes the place of the end mark
                ids = np.where(ids == end, -1, np.where(ids == len(words) - 1, end, ids)).astype(np.int32)
                words.pop()
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                 pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())],
                names=["chunk", "lang", "words", "counts", "ids"])
            chunk += 1

    def work(batches):
        held, size, chunk = {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= chunk_bytes:
                    yield from flush(held, chunk)
                    held, size, chunk = {}, 0, chunk + len(held)
        yield from flush(held, chunk)

    return work


def _filters(bits: int, shard: int, hold: int):
    """Filters of the 2- to 4-grams of frequent words, by language, length and first quotient bits."""
    packings = {n: Packing(n, bits) for n in range(2, LONGEST + 1)}

    def flush(held):
        for (lang, n), parts in held.items():
            p = packings[n]
            left, right = (np.concatenate(c) for c in zip(*parts))
            left, right, count = p.summed(left, right)
            bucket = (left >> np.uint64(p.left - min(shard, p.left))).astype(np.int64)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
            cells = [slice(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array([n] * len(cells), pa.int32()),
                 pa.array([int(bucket[c.start]) for c in cells], pa.int64()),
                 pa.array([encode(left[c], right[c], count[c], p, min(shard, p.left)) for c in cells], pa.binary())],
                names=["lang", "n", "bucket", "filter"])

    def work(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, ids, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                local = np.frombuffer(ids.as_buffer(), np.int32)
                known = known.values                            # the structs of this row's list
                if known is None or not len(known):
                    continue
                table = np.full(int(local.max()) + 2, -1, np.int64)
                table[known.field(0).to_numpy()] = known.field(1).to_numpy()
                numbers = table[local]                          # -1 takes the last place, which holds -1
                fits = numbers >= 0
                for n, p in packings.items():
                    fits = fits[:-1] & (numbers[n - 1:] >= 0) if n > 2 else fits[:-1] & fits[1:]
                    at = np.flatnonzero(fits)
                    if not len(at):
                        break
                    held.setdefault((lang, n), []).append(p.permute(*p.pack([numbers[at + k] for k in range(n)])))
                    size += len(at)
                if size >= hold:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return work


def _merged(bits: int, shard: int, least: int):
    """Keys of all filters of one (language, length, bucket) with their sums, where frequent, as word numbers."""
    packings = {n: Packing(n, bits) for n in range(2, LONGEST + 1)}

    def done(key, parts):
        lang, n, _ = key
        p = packings[n]
        left, right, count = (np.concatenate(c) for c in zip(*parts))
        left, right, count = p.summed(left, right, count)
        often = count >= least
        numbers = np.stack(p.unpack(*p.restore(left[often], right[often])), axis=1)
        size = len(numbers)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * n, pa.int32()), pa.array(numbers.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()), ids,
                                           pa.array(count[often], pa.int64())], names=["lang", "n", "ids", "f"])

    def work(batches):
        key, parts, size = None, [], 0
        for batch in batches:
            for lang, n, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, n, bucket) != key:
                    if parts:
                        yield done(key, parts)
                    key, parts, size = (lang, n, bucket), [], 0
                p = packings[n]
                parts.append(decode(data, p, min(shard, p.left), bucket))
                size += len(parts[-1][0])
                if size > 1 << 23 and len(parts) > 1:           # merge early: repeated keys take no more room
                    parts = [p.summed(*(np.concatenate(c) for c in zip(*parts)))]
                    size = 0
        if parts:
            yield done(key, parts)

    return work


# ------------------------------------------------------------ counts and scores

def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with a dense ``id`` from 0; the driver sees one count for each partition."""
    words = written(words.withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    part = F.shiftright("at", 33)
    sizes = sorted((r[0], r[1]) for r in words.groupBy(part.alias("part")).count().collect())
    first, rows = 0, []
    for k, n in sizes:
        rows.append((k, first))
        first += n
    starts = words.sparkSession.createDataFrame(rows, "part long, first long")
    return (words.withColumn("part", part).join(F.broadcast(starts), "part")
            .select(*[c for c in words.columns if c != "at"], (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id")))


def phrase_counts(docs: DataFrame, least: int = 30, chunk_bytes: int = 8 << 20, bucket_keys: int = 1 << 21):
    """Frequent words and phrases by language: ``(words, phrases)``.

    ``words(lang, word, f, n, id)``: words with at least ``least`` occurrences and
    the language's number n of all word occurrences; ``phrases(lang, n, ids, f)``:
    sequences of 1 to 4 word ids inside pieces with at least ``least``.  A phrase
    is at most as frequent as each of its words, so leaving other words out
    loses none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    chunks = written(texts.filter("text is not null").mapInArrow(
        _chunks(chunk_bytes), "chunk long, lang string, words array<string>, counts array<long>, ids binary"), "chunks")
    each = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).toDF("lang", "word", "f")
    counted = each.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    totals = chunks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n"))
    words = written(_numbered(counted.filter(F.col("f") >= least).join(totals, "lang")), "words")
    size, most = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    ones = words.select("lang", F.lit(1).alias("n"), F.array("id").alias("ids"), "f")
    if not size:
        return words, ones
    bits = max(1, int(size - 1).bit_length())
    # as many buckets as keep a bucket's keys under the given number, whatever the input's size
    shard = max(0, int(most // bucket_keys).bit_length())
    known = (chunks.select("chunk", "lang", F.posexplode("words").alias("pos", "word"))
             .join(words.select("lang", "word", "id"), ["lang", "word"])
             .groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("known")))
    filters = chunks.select("chunk", "lang", "ids").join(known, "chunk").select("lang", "ids", "known").mapInArrow(
        _filters(bits, shard, 1 << 21), "lang string, n int, bucket long, filter binary")
    phrases = written(filters.repartition("lang", "n", "bucket").sortWithinPartitions("lang", "n", "bucket").mapInArrow(
        _merged(bits, shard, least), "lang string, n int, ids array<long>, f long"), "phrases")
    return words, ones.unionByName(phrases)


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to 4 words of each language.

    Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends into
    pieces, pieces at spaces and tabs into words.  a counts the phrase's
    occurrences (overlaps too), l and r those of its parts at the cut with the
    lowest score floor(2000000 a / (l + r)), the first of equal ones; n counts
    the language's words.  Phrases under ``least`` are no candidates.  A
    candidate inside a longer candidate that has at least ``covered`` percent of
    its occurrences is dropped.  Null texts are empty, a null lang is ``und``,
    repeated rows count each, and doc_id plays no part.  An empty table gives no
    rows.  Arithmetic is on decimals of 38 digits.
    """
    words, counts = phrase_counts(docs, least)
    wide = "decimal(38,0)"
    found = counts.filter("n > 1").withColumnRenamed("f", "a")
    cuts = (found.withColumn("k", F.explode(F.expr("sequence(1, n - 1)")))
            .withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, n - k)")))
    part = counts.select("lang", "ids", "f")
    cuts = (cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"])
            .join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
            .withColumn("score", F.expr(f"(cast(2000000 as {wide}) * cast(a as decimal(20,0))) div (l + r)")))
    scored = (cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.min("a").alias("a")))
    inner = (found.filter("n > 2").withColumn("m", F.explode(F.expr("sequence(2, n - 1)")))
             .withColumn("s", F.explode(F.expr("sequence(1, n - m + 1)")))
             .groupBy("lang", F.expr("slice(ids, s, m)").alias("ids")).agg(F.max("a").alias("outer_f")))
    kept = scored.join(inner, ["lang", "ids"], "left").filter(
        f"outer_f is null or cast(100 as {wide}) * cast(outer_f as decimal(20,0)) "
        f"< cast({covered} as {wide}) * cast(a as decimal(20,0))")
    kept = written(kept.select("lang", "ids", "a", "low.l", "low.r", "low.score"), "scored")
    named = (kept.select("lang", "ids", F.posexplode("ids").alias("pos", "id"))
             .join(words.select("id", "word", F.col("n").alias("all_words")), "id")
             .groupBy("lang", "ids").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), ' ')")
                                         .alias("phrase"), F.min("all_words").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (kept.join(named, ["lang", "ids"]).withColumn("rank", rank).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


_NGRAMS = "\n".join(
    f"  {'union all ' if k > 1 else ''}select lang, {k} as len, array_to_string(w[i:i + {k - 1}], ' ') as phrase "
    f"from (select lang, w, unnest(generate_series(1, len(w) - {k - 1})) as i from pieces where len(w) >= {k})"
    for k in range(1, LONGEST + 1))

ORACLE = rf"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
pieces as materialized (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w
  from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from texts)),
grams as (
{_NGRAMS}),
f as materialized (select lang, len, phrase, count(*) as f from grams group by all having count(*) >= 30 or len = 1),
totals as (select lang, sum(f)::bigint as n from f where len = 1 group by lang),
cand as (select *, string_split(phrase, ' ') as w from f where len > 1),
cuts as (
  select c.lang, c.phrase, c.len, c.w, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f + r.f) as score
  from (select *, unnest(generate_series(1, len - 1)) as k from cand) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(w[s:s + m - 1], ' ') as phrase, max(f) as outer_f
  from (select *, unnest(generate_series(1, len - m + 1)) as s
        from (select *, unnest(generate_series(2, len - 1)) as m from cand where len > 2))
  group by all),
ranked as (
  select low.lang, row_number() over (partition by low.lang order by score desc, a desc, low.phrase) as rank, low.phrase, a, l, r, n, score
  from low join totals using (lang) left join inside on inside.lang = low.lang and inside.phrase = low.phrase
  where outer_f is null or 100::hugeint * outer_f < 80::hugeint * a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked where rank <= 2000"""
