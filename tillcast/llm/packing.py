"""Packing of tokenised documents into power-of-two windows, in tiers.

Documents are routed to the context-size tier that holds them (256, 512, 1024
or 2048 tokens; longer ones first give whole 2048 windows).  Windows of the
long tiers are opened first; each starts with one piece of its own tier, and
its gap is filled with the largest pieces of the shorter tiers that fit, then
with the head of one more piece.  So every window is full.  The tail of a
partition is cut into smaller powers of two.  Windows of a tier form step
groups of equal token counts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import count
from struct import pack
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import small_batches, text_bytes

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: The byte-level tokenizers' letter for each byte: itself if printable, else the next from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


class WordTokens:
    """Token ids of texts by a tokenizer that never joins what ASCII white space parts.

    The ids of a text are then those of its words in turn, so words are encoded
    once and kept in two generations of at most ``most`` words each.  ``of``
    keeps one such memory in a worker process for all its tasks.

    A word of small letters, in composed form, passes the tokenizer's
    normaliser and splitter unchanged and goes straight to its BPE model; a
    full stop or comma after such a word is a token run of its own.
    """

    _memory: dict[str, WordTokens] = {}

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.fresh, self.old = most, {}, {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._memory:
            cls._memory[path] = cls(path)
        return cls._memory[path]

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and word == word.lower() and is_normalized("NFC", word):
            inner = word if word.isascii() else "".join([BYTE_LETTERS[b] for b in word.encode()])
            ids = [t.id for t in self.tokenizer.model.tokenize(inner)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _of(self, word: bytes) -> bytes:
        ids = self.fresh.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                text = word.decode()
                if text[-1] in ".," and text[-2:-1].lower().isalpha() and "<|" not in text:
                    ids = self._of(word[:-1]) + self._of(word[-1:])
                else:
                    low = word.lower()
                    ids = self._of(low) if low != word and b"<|" not in word else self._ids(text)
            self.fresh[word] = ids
        return ids

    def _learn(self, words: set[bytes]) -> None:
        if len(self.fresh) + len(words) > self.most:
            self.fresh, self.old = {}, self.fresh
        for w in words.difference(self.fresh):
            self._of(w)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]
        out = []
        for at in range(0, len(split), 64):
            part = split[at:at + 64]
            self._learn(set().union(*part))
            get = self.fresh.__getitem__
            out.extend(b"".join(map(get, words)) for words in part)
        return out


class _Packer:
    """Pool of pieces, largest first; a piece is (length, order, doc, start) with its ids at hand."""

    def __init__(self, partition: int, tiers: tuple[int, ...], group_tokens: int):
        self.tiers, self.group_tokens = tiers, group_tokens
        self.base, self.sequences, self.order = partition << 32, 0, count()
        self.pool: list[tuple] = []
        self.tokens = 0
        self.in_tier: dict[int, int] = {}
        self.rows: list[tuple] = []

    def put(self, length: int, doc: tuple, start: int) -> None:
        insort(self.pool, (length, next(self.order), doc, start))
        self.tokens += length

    def add(self, doc_id, ids: bytes) -> None:
        doc = (doc_id, ids, len(ids) // 4)
        whole = doc[2] - doc[2] % self.tiers[-1]
        for start in range(0, whole, self.tiers[-1]):
            self.close([(self.tiers[-1], doc, start)], self.tiers[-1])
        if doc[2] > whole:
            # a piece keeps only its own ids, so a long document is let go
            rest = (doc_id, ids[whole * 4:], doc[2])
            self.put(doc[2] - whole, rest, whole)

    def close(self, pieces: list[tuple], size: int) -> None:
        sequence = self.base + self.sequences
        self.sequences += 1
        n = self.in_tier.get(size, 0)
        self.in_tier[size] = n + 1
        group = self.base + (size.bit_length() << 26) + n // max(1, self.group_tokens // size)
        offset = 0
        for length, (doc_id, ids, total), start in pieces:
            first = start - (total - len(ids) // 4)      # where the piece starts in the ids at hand
            crc = crc32(ids[first * 4:(first + length) * 4])
            self.rows.append((doc_id, start, length, crc, total, sequence, offset, size, group))
            offset += length

    def run(self, reserve: int) -> None:
        """Pack until the pool holds ``reserve`` tokens or fewer (0: everything)."""
        while self.pool and self.tokens > reserve:
            length, _, doc, start = self.pool.pop()
            self.tokens -= length
            size = next(t for t in self.tiers if t >= length)
            pieces, gap = [(length, doc, start)], size - length
            while gap and self.pool:
                at = bisect_right(self.pool, (gap, float("inf"))) - 1
                length, _, doc, start = self.pool.pop(max(at, 0))
                self.tokens -= length
                if length > gap:                         # no piece fits: cut the shortest
                    self.put(length - gap, doc, start + gap)
                    length = gap
                pieces.append((length, doc, start))
                gap -= length
            if gap:                                      # the last window: cut it at a power of two
                used = size - gap
                size = 1 << (used.bit_length() - 1)
                over = used - size
                while over:
                    length, doc, start = pieces.pop()
                    cut = min(length, over)
                    self.put(cut, doc, start + length - cut)
                    over -= cut
                    if length > cut:
                        pieces.append((length - cut, doc, start))
            self.close(pieces, size)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS,
         group_tokens: int = 16_384, reserve: int = 262_144) -> DataFrame:
    """Pack the tokens of every document: one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32 (of the piece's little-endian 32-bit ids), doc_tokens (with the
    end id), sequence_id, offset in the sequence, tier (the window's length) and
    step_group (windows of one tier with ``group_tokens`` tokens in all).

    Each input partition packs its own documents, so nothing is shuffled and a
    lost task packs its partition again by itself; ids of sequences and groups
    start from the partition's number.  Null, empty and blank texts are the end
    id alone; rows with a null or repeated doc_id are packed as any other.  No
    row is dropped and an empty table gives no rows.  ``tokenizer_path``
    defaults to the 49k word BPE of the installed tokenizer files; it must be
    readable on the executors.
    """
    def work(batches):
        path = tokenizer_path
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        words = WordTokens.of(path)
        packer = _Packer(TaskContext.get().partitionId(), tiers, group_tokens)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in small_batches(batches, "text", 4 << 20):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(text_bytes(batch.column(1)))):
                packer.add(doc_id, ids + end)
            packer.run(reserve)
            yield packer.taken()
        packer.run(0)
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
