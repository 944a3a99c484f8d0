"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the popcounts of its 32 two-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so pairs within ``max_bits`` are found by a range join under
Manhattan distance and then verified on the bits.

The range join works on a unit grid.  The 32 coordinates are dealt to
``groups`` groups; two embeddings within ``max_bits`` differ in at most
``max_bits`` groups, so they share a grid cell in the projection on some
``groups - max_bits`` of them.  Each fingerprint is put into its cell of every
such projection, and only fingerprints of one cell are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import (components, dealt_pairs, group_ids, small_batches, text_bytes, unite,
                                 whole_groups, written)

SEGMENT_BITS = 2
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: words split at ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    k = min(shingle, len(words))
    ends = np.append(starts[k:] - 1, len(joined)).tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(ends)
    starts = starts[:total].tolist()
    for at in range(0, total, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keyed: bool = False) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long.

    With ``keyed`` a hash of the text comes between them, as ``text_key``.
    """
    names = ["doc_id", "text_key", "fp"] if keyed else ["doc_id", "fp"]

    def work(batches):
        for batch in small_batches(batches, "text"):
            fps = [fingerprint(t, shingle) for t in text_bytes(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             names=names)

    text = F.col("text").cast("string")
    key = [F.xxhash64(text).alias("text_key")] if keyed else []
    return docs.select(F.col("doc_id").cast("long"), *key, text.alias("text")).mapInArrow(
        work, ", ".join(f"{n} long" for n in names))


def _cells(fps: DataFrame, groups: int, max_bits: int) -> DataFrame:
    """``(cell, fp)``: the grid cells of each fingerprint, one for each projection."""
    segments = 64 // SEGMENT_BITS
    dealt = [range(g, segments, groups) for g in range(groups)]
    mask = (1 << SEGMENT_BITS) - 1

    def vector(g: int) -> str:        # the popcounts of a group, as one number
        return " + ".join(f"{(SEGMENT_BITS + 1) ** i}L * bit_count(shiftrightunsigned(fp, {SEGMENT_BITS * s}) & {mask}L)"
                          for i, s in enumerate(dealt[g]))

    vectors = fps.select("fp", *[F.expr(f"cast({vector(g)} as long)").alias(f"g{g}") for g in range(groups)])
    cells = [F.xxhash64(F.lit(p), *[F.col(f"g{g}") for g in kept])
             for p, kept in enumerate(combinations(range(groups), groups - max_bits))]
    return vectors.select(F.explode(F.array(*cells)).alias("cell"), "fp")


def _linked(max_bits: int):
    """Links of a task's members that join sets not yet joined (a spanning forest of its links)."""
    def work(batches):
        keys = ["cell", "part_i", "part_j"]
        for table in whole_groups(batches, keys):
            group = group_ids(table, keys)
            fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            n = len(fp)
            parent = np.arange(n)
            out_a, out_b = [], []
            at = np.arange(n)
            for lag in range(1, n):
                at = at[at + lag < n]
                at = at[group[at] == group[at + lag]]
                if not len(at):
                    break
                near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= max_bits]
                near = near[parent[near] != parent[near + lag]]
                if len(near):
                    unite(parent, near, near + lag)
                    out_a.append(fp[near])
                    out_b.append(fp[near + lag])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])
    return work


def links(fps: DataFrame, max_bits: int = 3, groups: int = 6, block: int = 4096) -> DataFrame:
    """Links between different fingerprints at ``max_bits`` or fewer differing bits.

    ``fps`` has distinct ``fp``.  The result connects every pair of linked
    fingerprints, directly or by other links, and holds no link farther apart.
    """
    tasks = dealt_pairs(_cells(fps, groups, max_bits), ["cell"], "fp", block)
    keys = ["cell", "part_i", "part_j"]
    return (tasks.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_linked(max_bits), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, groups: int = 6) -> DataFrame:
    """Near-duplicate classes: ``(doc_id, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Rows of one fingerprint are one node, so
    exact copies cost one row however many there are.  Null, empty and blank
    texts have fingerprint 0 and link like any other.  A null doc_id is never a
    component's smallest id; a component without any id has a null id.  An
    empty table gives no rows.
    """
    return _classes(fingerprints(docs, shingle), max_bits, groups)


def _classes(fps: DataFrame, max_bits: int, groups: int = 6) -> DataFrame:
    """``fps`` with the ``component_id`` of each row."""
    fps = written(fps, "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    member = components(links(nodes.select("fp"), max_bits, groups))
    sets = nodes.join(member, nodes.fp == member.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("set_id"))
    smallest = sets.groupBy("set_id").agg(F.min("first_id").alias("component_id"))
    of_fp = sets.join(smallest, "set_id").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(*fps.columns, "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the smallest doc_id.

    Each row is judged by its own text, so of rows that share an id but not a
    class each goes or stays by itself.  Rows of a class that repeat its
    smallest doc_id all stay, as does every row without an id.
    """
    classes = _classes(fingerprints(docs, shingle, keyed=True), max_bits)
    gone = (classes.filter("doc_id <> component_id")
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"])
                     & (F.xxhash64(docs["text"].cast("string")) == gone["gone_key"]), "left_anti")
