"""Helpers shared by the operators: scratch tables, words, grouped batches, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ------------------------------------------------------------ scratch tables

def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without that setting and then gets a folder of
    its own; a cluster session without it is refused, because a folder of one
    machine is not seen by the others.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tillcast-llm-")
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/llm-{sc.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


_FOLDERS: set[str] = set()


def _drop(spark: SparkSession, folder: str) -> None:
    """Remove the scratch tables of this process when it ends, if Spark still runs."""
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    This cuts the lineage: an executor that is lost later costs a re-read of
    the file, not the work before it.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------ Arrow batches

def small_batches(batches, size_of: str, most: int = 8 << 20):
    """Cut Arrow batches so that column ``size_of`` holds about ``most`` bytes each."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        step = max(1, min(n, int(n * most / max(1, column.nbytes))))
        for start in range(0, n, step):
            yield batch.slice(start, step)


def rows_by_text(docs: DataFrame, judge) -> DataFrame:
    """Rows of ``docs`` whose text is kept, with all columns.

    ``judge()`` is called once a task and gives a function from an Arrow column
    of texts (null where the row has none) to booleans.  A ``mapInArrow`` does
    this, not a filter by a Python function: the optimiser moves a filter below
    other operators, where a text that is still an expression cannot be given
    to Python.
    """
    at = docs.columns.index("text")

    def work(batches):
        keeps = judge()
        for batch in batches:
            column = batch.column(at)
            if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                column = column.cast(pa.string())
            yield batch.filter(pa.array(keeps(column), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def whole_groups(batches, keys: list[str], most_rows: int = 1 << 16):
    """Join sorted Arrow batches so that each piece holds complete key groups.

    The input partition is sorted by ``keys``; a piece has at least
    ``most_rows`` rows unless it is the last, and a group is never cut.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_start(table, keys)
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_start(table: pa.Table, keys: list[str]) -> int:
    n = table.num_rows
    same = np.ones(n, bool)
    for k in keys:
        v = table.column(k).to_numpy()
        same &= v == v[-1]
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def group_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, 2, ... for the runs of equal keys of a sorted table."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def dealt_pairs(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Deal the members of each key group to tasks that compare them in blocks.

    A group of at most ``block`` members is one task.  A larger one is dealt by
    a hash of ``member`` to ``m`` parts, and every pair of parts is a task, so
    no task holds more than about two blocks and every pair of members meets in
    one task at least.  Groups of one member are left out.  Adds the task
    (``part_i``, ``part_j``) and the member's own part (``part``).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n")).filter("group_n > 1")
    parts = F.expr(f"cast(ceil(group_n / {block}) as int)")
    own = F.expr(f"cast(pmod(xxhash64({member}), n_parts) as int)")
    met = F.expr("explode(transform(sequence(0, n_parts - 1), "
                 "j -> struct(least(part, j) as i, greatest(part, j) as j)))")
    return (rows.join(sizes, keys)
            .withColumn("n_parts", parts).withColumn("part", own).withColumn("met", met)
            .withColumn("part_i", F.col("met.i")).withColumn("part_j", F.col("met.j"))
            .drop("met", "n_parts", "group_n"))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of ``a[k]`` and ``b[k]`` in place; ``parent`` stays flat."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


# ------------------------------------------------------------ components

def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, component)``.

    The component is its smallest node.  Alternating large-star and small-star
    steps; each is a map-side-combined minimum and one join, so no component
    meets in one task.  Every round is written to the shared folder.  Nodes
    without an edge are not in the result.
    """
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a > b").distinct())
    e = written(e, "edges")
    print_of = _fingerprint(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = (both.filter("v > u").join(low, "u")
                .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(low, "a")
        e = written(joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .union(low.select("a", "m")).distinct(), "edges")
        now = _fingerprint(e)
        if now == print_of:
            break
        print_of = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b"), F.col("b")).distinct())


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
