"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

Normalised vectors are projected on random normal directions; a projection,
shifted at random and cut to steps of ``step``, is a hash that near vectors
share (Euclidean distance is 0.2 at cosine 0.98).  ``width`` hashes make the
bucket of a table, and ``tables`` tables are kept.  Vectors that meet in a
bucket of any table and have one label are compared by cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import components, dealt_pairs, group_ids, unite, whole_groups, written

SEED = 20_260_101
KEYS = ["table_no", "bucket", "part_i", "part_j"]


def _matrix(column) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).reshape(n, -1)


def signatures(vectors: DataFrame, width: int, tables: int, step: float) -> DataFrame:
    """``(class_id, unit, marks)``: the normalised vector and its bucket in each table."""
    def work(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column(2).value_lengths())
            label = np.asarray(batch.column(1), np.int64)
            order, units, marks = [], [], []
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = _matrix(batch.column(2).take(pa.array(rows))).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)          # so that no square overflows or vanishes
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                if d not in planes:
                    rng = np.random.default_rng([SEED, d])
                    planes[d] = (rng.standard_normal((d, width * tables)), rng.random(width * tables) * step,
                                 rng.integers(1, 2**63, size=(tables, width + 1), dtype=np.uint64) | np.uint64(1))
                a, b, mix = planes[d]
                cells = np.floor((x @ a + b) / step).astype(np.int64).view(np.uint64).reshape(len(x), tables, width)
                with np.errstate(over="ignore"):
                    key = (cells * mix[None, :, :-1]).sum(axis=2, dtype=np.uint64)
                    key += label[rows].view(np.uint64)[:, None] * mix[None, :, -1] + np.uint64(d)
                    key ^= key >> np.uint64(29)
                    key *= np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(32)
                order.extend(rows.tolist())
                units.extend(x)
                marks.extend(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(order)), pa.array(label[order]),
                 pa.array(units, pa.list_(pa.float64())), pa.array(marks, pa.list_(pa.int64()))],
                names=["class_id", "label", "unit", "marks"])

    return vectors.mapInArrow(work, "class_id long, label long, unit array<double>, marks array<long>")


def _compared(cosine: float):
    """Links found in a bucket that no table before it has met.

    Gives rows (a, b, n): b null and n the weight of the vectors linked with a,
    or a link (a, b) that joins two sets not joined before.
    """
    def work(batches):
        for table in whole_groups(batches, KEYS, 1 << 13):
            group = group_ids(table, KEYS)
            bounds = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            number = table.column("table_no").to_numpy()
            part, i, j = (table.column(c).to_numpy() for c in ("part", "part_i", "part_j"))
            ids, weight, label = (table.column(c).to_numpy() for c in ("class_id", "weight", "label"))
            out_a, out_b, out_n = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                piece = table.slice(a, b - a)
                sizes = np.asarray(piece.column("unit").combine_chunks().value_lengths())
                if (sizes != sizes[0]).any():           # a hash clash of vectors of two lengths
                    continue
                x, marks = _matrix(piece.column("unit")), _matrix(piece.column("marks"))
                met = x @ x.T >= cosine - 1e-12
                met &= label[a:b, None] == label[None, a:b]
                if i[a] != j[a]:                         # two parts: pairs within a part are another task's
                    met &= part[a:b, None] != part[None, a:b]
                np.fill_diagonal(met, False)
                p, q = np.nonzero(np.triu(met))
                if not len(p):
                    continue
                exact = np.einsum("ij,ij->i", x[p], x[q])
                before = (marks[p, :number[a]] == marks[q, :number[a]]).any(axis=1)
                sure = (exact >= cosine) & ~before
                p, q = p[sure], q[sure]
                if not len(p):
                    continue
                w = np.bincount(p, weight[a:b][q], b - a) + np.bincount(q, weight[a:b][p], b - a)
                some = np.flatnonzero(w)
                out_a.append(ids[a:b][some])
                out_b.append(np.full(len(some), -1))
                out_n.append(w[some].astype(np.int64))
                parent = np.arange(b - a)
                while len(p):                            # a forest of the links, a few links a round
                    _, first = np.unique(q, return_index=True)
                    out_a.append(ids[a:b][p[first]])
                    out_b.append(ids[a:b][q[first]])
                    out_n.append(np.zeros(len(first), np.int64))
                    unite(parent, p[first], q[first])
                    left = parent[p] != parent[q]
                    p, q = p[left], q[left]
            if out_a:
                b = np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(b, pa.int64(), mask=b < 0), pa.array(np.concatenate(out_n))],
                    names=["a", "b", "n"])
    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, width: int = 10, tables: int = 24,
                    step: float = 1.2, block: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Two vectors of one label (not null) and one length link at ``cosine`` or
    more, in double precision.  ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest vec_id reachable by links and
    ``kept`` says whether that is the row's own.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do rows
    with a null label; they are their own component.  Rows with one label and
    one vector are one class however many there are: they are compared once and
    counted by their number.  A null vec_id never is a component's smallest id.
    With the defaults a pair at the threshold meets in some table with a
    probability above 0.99, nearer pairs more surely.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("label is not null and embedding is not null and size(embedding) > 0 "
                   "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
                   "and exists(embedding, x -> x <> 0)")
    rows = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("key_a", F.when(F.col("sound"), F.xxhash64("label", "embedding"))).withColumn(
        "key_b", F.when(F.col("sound"), F.xxhash64("embedding", "label")))
    classes = (rows.filter("sound").groupBy("key_a", "key_b")
               .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"),
                    F.first("label").alias("label"), F.first("embedding").alias("embedding"))
               .withColumn("class_id", F.expr("key_a & 9223372036854775807")))
    classes = written(classes, "classes")
    sign = written(signatures(classes.select("class_id", "label", "embedding"), width, tables, step), "signatures")
    met = sign.select("class_id", F.posexplode("marks").alias("table_no", "bucket"))
    tasks = dealt_pairs(met, ["table_no", "bucket"], "class_id", block)
    loaded = (tasks.join(sign, "class_id").join(classes.select("class_id", "weight"), "class_id")
              .repartition(*KEYS).sortWithinPartitions(*KEYS)
              .select(*KEYS, "part", "class_id", "weight", "label", "unit", "marks"))
    found = written(loaded.mapInArrow(_compared(cosine), "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    member = components(found.filter("b is not null").select("a", "b"))
    sets = (classes.select("class_id", "key_a", "key_b", "first_id", "weight")
            .join(member.withColumnRenamed("node", "class_id"), "class_id", "left")
            .withColumn("set_id", F.coalesce("component", "class_id")))
    smallest = sets.groupBy("set_id").agg(F.min("first_id").alias("component_id"))
    of_class = (sets.join(smallest, "set_id").join(counts, "class_id", "left")
                .select("key_a", "key_b", "component_id",
                        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return (rows.select("vec_id", "key_a", "key_b").join(of_class, ["key_a", "key_b"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
