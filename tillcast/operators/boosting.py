"""Gradient-boosted trees for all families at once, by histograms (M6, M7).

Features are cut at quantiles of each family's rows.  A round grows one tree a
family, all families together: each level is one aggregate by (family, node,
feature, bin) over rows that carry their current prediction, and the best split
of each node comes from running sums over at most ``bins`` bins.  Trees are
rows of a table, one a family and round.  The driver sees the names of the
families, the splits of their current trees and their errors, never their rows,
and no family's rows meet in one task.

With G the sum of residuals and n the rows of a node, a leaf is worth
``step * G / (n + l2)``, and a split gains half of the rise in G^2 / (n + l2).
``leaves`` keeps only the splits that best-first growth would make: always the
leaf with the largest gain next, until that many leaves.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.constants import COLSAMPLE, GBT_SEED, SUBSAMPLE
from tillcast.session import checkpoint_dir, materialize

FIT, VALID, TEST = "fit", "valid", "test"
SPLIT = "struct<f:int,b:int,gain:double,sl:double,nl:long,sr:double,nr:long>"
ROWS_A_TASK = 50_000    # rows worth a task of their own while cores are free
MOST_ROWS = 500_000     # rows of one partition in a round
KEEP_EVERY = 25         # rounds between two checkpoints of the rows' state


@dataclass
class Boosted:
    """``predictions``: all rows with their role and the prediction of their family's best round;
    ``trees``: (key, round, splits); ``cuts``: (key, base, cuts); ``rounds``: (key, best_round, best_error)."""
    predictions: DataFrame
    trees: DataFrame
    cuts: DataFrame
    rounds: DataFrame
    step: float
    l2: float
    depth: int


# ------------------------------------------------------------------ bins and roles

def quantile_cuts(rows: DataFrame, key: str, features: list[str], target: str, bins: int = 32) -> DataFrame:
    """(key, base, cuts): mean target, and for each feature its distinct quantiles at k / bins.

    The sketch is exact below 10,000 rows a family and mergeable above.
    """
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    per = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), share, F.lit(10_000)))) for f in features]
    return rows.groupBy(key).agg(F.avg(F.col(target).cast("double")).alias("base"), F.array(*per).alias("cuts"))


def binned(df: DataFrame, features: list[str]) -> Column:
    """Bin numbers of ``features``: how many cuts are below the value; a null value is in bin 0."""
    def below(i: int, value: Column) -> Column:
        return F.size(F.filter(F.get("cuts", F.lit(i)), lambda c: c < value)).cast("int")
    return F.array(*[below(i, F.col(f).cast("double")) for i, f in enumerate(features)])


def hold_out_last(rows: DataFrame, key: str, date_col: str, cut: str, share: float = 0.2) -> DataFrame:
    """Roles: test from ``cut`` on; of the weeks before, each family's last ``share`` of rows validates."""
    day = F.datediff(F.to_date(date_col), F.lit("1970-01-01").cast("date"))
    before = F.to_date(date_col) < F.lit(cut).cast("date")
    edge = rows.filter(before).groupBy(key).agg(F.percentile_approx(day, F.lit(1 - share), F.lit(10_000)).alias("_edge"))
    role = F.when(~before, TEST).when(day > F.col("_edge"), VALID).otherwise(FIT)
    return rows.filter(F.col(date_col).isNotNull()).join(edge, key).withColumn("role", role).drop("_edge")


# ------------------------------------------------------------------ one tree

def _node_sql(depth: int) -> str:
    """Node of a row: from the root (1) along the splits; node v has children 2v and 2v + 1."""
    return f"""aggregate(sequence(1, {depth}), 1, (v, x) -> if(try_element_at(splits, v) is null, v,
        2 * v + if(bins[try_element_at(splits, v).f] > try_element_at(splits, v).b, 1, 0)))"""


def _node(depth: int) -> Column:
    return F.expr(_node_sql(depth))


def _leaf_value(step: float, l2: float) -> Column:
    """Value of node ``node`` from its parent's split; 0 where the family's tree has no split."""
    return F.expr(f"""case when node > 1 then {step!r}D * if(node % 2 = 0,
        try_element_at(splits, node div 2).sl / (try_element_at(splits, node div 2).nl + {l2!r}D),
        try_element_at(splits, node div 2).sr / (try_element_at(splits, node div 2).nr + {l2!r}D)) else 0D end""")


def _level_sql(key: str, node: str, keep: str, l2: float, min_rows: int) -> str:
    """Best split of each node as (key, node, split), from view ``{rows}``.

    A node and feature has at most ``bins`` cells, so running sums go over a
    short array, and once the rows are summed a family's cells (nodes x features
    x bins) move together: one exchange for all that follows.
    """
    return f"""
    with cells as (
      select `{key}`, node, res, inline(transform(chosen, i -> struct(i as f, bins[i] as b)))
      from (select `{key}`, {node} as node, res, bins, chosen from {{rows}}) where {keep}),
    hist as (select `{key}`, node, f, b, sum(res) as s, count(*) as n from cells group by `{key}`, node, f, b),
    near as (select * from hist distribute by `{key}`),
    per as (select `{key}`, node, f, array_sort(collect_list(struct(b, s, n))) as h from near group by `{key}`, node, f),
    runs as (select `{key}`, node, f, aggregate(h, 0D, (a, c) -> a + c.s) as all_s, aggregate(h, 0L, (a, c) -> a + c.n) as all_n,
             inline(aggregate(h, cast(array() as array<struct<b:int,sl:double,nl:long>>),
               (a, c) -> concat(a, array(named_struct('b', c.b, 'sl', coalesce(try_element_at(a, -1).sl, 0D) + c.s,
                                                      'nl', coalesce(try_element_at(a, -1).nl, 0L) + c.n))))) from per),
    gains as (select *, all_s - sl as sr, all_n - nl as nr,
              0.5D * (sl * sl / (nl + {l2!r}D) + (all_s - sl) * (all_s - sl) / (all_n - nl + {l2!r}D)
                      - all_s * all_s / (all_n + {l2!r}D)) as gain from runs)
    select `{key}`, node, max_by(struct(f, b, gain, sl, nl, sr, nr), struct(gain, -f, -b)) as split
    from gains where nl >= {min_rows} and nr >= {min_rows} and gain > 1e-9 group by `{key}`, node"""


def best_splits(rows: DataFrame, key: str, l2: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(key, node, split): the best split of each node of ``rows(key, node, res, bins, chosen)``, where any gains.

    ``chosen`` are the numbers of the features that may split.  Equal gains go
    to the first feature, then the lowest bin.
    """
    return rows.sparkSession.sql(_level_sql(key, "node", "true", l2, min_rows), rows=rows)


def best_first(splits: dict[int, float], leaves: int) -> set[int]:
    """Nodes that best-first growth splits until there are ``leaves`` leaves; ``splits``: node -> gain."""
    heap, kept = [(-splits[1], 1)] if 1 in splits else [], set()
    while heap and len(kept) < leaves - 1:
        _, v = heapq.heappop(heap)
        kept.add(v)
        for child in (2 * v, 2 * v + 1):
            if child in splits:
                heapq.heappush(heap, (-splits[child], child))
    return kept


# ------------------------------------------------------------------ rows as arrays

@dataclass
class Block:
    """Rows of one family in one partition; ``best`` is the prediction of the family's best round so far."""
    ids: np.ndarray
    role: np.ndarray        # FIT, VALID or TEST as 0, 1, 2
    y: np.ndarray
    h: np.ndarray           # hash of row number and seed, from which each round draws its rows
    bins: np.ndarray        # rows x features
    pred: np.ndarray
    best: np.ndarray


def _parts(rows: int, cores: int) -> int:
    """Partitions of the rows in a round: starting a task costs more than summing ROWS_A_TASK rows, so up to
    MOST_ROWS rows a core one task a core does a level in one wave."""
    return max(1, min(-(-rows // ROWS_A_TASK), cores), -(-rows // MOST_ROWS))


def _row_blocks(data: DataFrame, key: str, n_features: int, bins: int, parts: int) -> RDD:
    """RDD of (key, Block) with one block a family and partition, from ``data(key, _id, _role, _y, _h, bins, base)``."""
    small = np.min_scalar_type(bins)

    def arrays(batches):
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                cells = np.array(part["bins"].tolist(), dtype=float).reshape(len(part), n_features)
                yield pd.DataFrame({key: [k], "block": [pickle.dumps(Block(
                    part["_id"].to_numpy("int64"), part["_role"].to_numpy("int8"), part["_y"].to_numpy("float64"),
                    part["_h"].to_numpy("int64").view("uint64"), np.nan_to_num(cells).astype(small),
                    part["base"].to_numpy("float64"), part["base"].to_numpy("float64")))]})

    def joined(rows):
        found = {}
        for k, block in rows:
            found.setdefault(k, []).append(pickle.loads(block))
        for k, some in found.items():
            yield k, Block(*[np.concatenate([getattr(x, f.name) for x in some]) for f in fields(Block)])

    schema = T.StructType([data.schema[key], T.StructField("block", T.BinaryType())])
    return data.repartition(parts, "_id").mapInPandas(arrays, schema).rdd.mapPartitions(joined)


def _drawn(h: np.ndarray, r: int, share: float) -> np.ndarray:
    """Which rows round ``r`` draws: pmod(xxhash64(row number, seed, r), 1000000) below the share (XXH64 of 4 bytes with seed ``h``)."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        x = (h + p5 + np.uint64(4)) ^ (np.uint64(r) * p1)
        x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * p2 + p3
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
    return np.mod((x ^ (x >> np.uint64(32))).view("int64"), 1_000_000) < int(share * 1_000_000)


def _nodes(bins: np.ndarray, splits: dict, depth: int) -> np.ndarray:
    """Node of each row, from the root (1) along ``splits`` {node: (f, b, gain, sl, nl, sr, nr)}."""
    feature, cut = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1))
    for v, s in splits.items():
        feature[v], cut[v] = s[0], s[1]
    node, rows = np.ones(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + (bins[rows, f] > cut[node]), node)
    return node


def _cells(block: Block, splits: dict, level: int, r: int, share: float, chosen: list[int], bins: int):
    """(node, sums): per node of ``level`` the residuals and counts of round ``r``'s rows by (chosen feature, bin)."""
    use = (block.role == 0) & _drawn(block.h, r, share)
    cells, res = block.bins[use], (block.y - block.pred)[use]
    node = _nodes(cells, splits, level)
    deep = node >= 2 ** level
    found, at = np.unique(node[deep], return_inverse=True)
    if not len(found):
        return
    cells, res, out = cells[deep], res[deep], np.empty((len(found), len(chosen), bins, 2))
    for i, f in enumerate(chosen):
        cell = at * bins + cells[:, f]
        out[:, i, :, 0] = np.bincount(cell, res, len(found) * bins).reshape(len(found), bins)
        out[:, i, :, 1] = np.bincount(cell, minlength=len(found) * bins).reshape(len(found), bins)
    yield from zip(found.tolist(), out)


def _best_cut(cells: np.ndarray, chosen: list[int], l2: float, min_rows: int):
    """The split of :func:`best_splits` from one node's sums, or None; gains that differ by rounding alone are equal."""
    run = cells.cumsum(axis=1)
    sl, nl = run[..., 0], run[..., 1]
    total = run[:, -1:, :]
    sr, nr = total[..., 0] - sl, total[..., 1] - nl
    gain = 0.5 * (sl * sl / (nl + l2) + sr * sr / (nr + l2) - total[..., 0] ** 2 / (total[..., 1] + l2))
    gain = np.where((nl >= min_rows) & (nr >= min_rows) & (gain > 1e-9), gain, -1.0)
    top = gain.max()
    if top < 0:
        return None
    i, b = np.unravel_index(np.argmax(gain >= top - 1e-10 * top), gain.shape)
    return (chosen[i], int(b), float(gain[i, b]), float(sl[i, b]), int(nl[i, b]), float(sr[i, b]), int(nr[i, b]))


def _moved(block: Block, splits: dict, improved: bool, depth: int, step: float, l2: float) -> Block:
    """The block after one more tree; if the round before was the best so far, its prediction is kept as ``best``."""
    value = np.zeros(2 ** (depth + 1))
    for v, (_, _, _, sl, nl, sr, nr) in splits.items():
        value[2 * v], value[2 * v + 1] = step * (sl / (nl + l2)), step * (sr / (nr + l2))
    return replace(block, pred=block.pred + value[_nodes(block.bins, splits, depth)],
                   best=block.pred if improved else block.best)


# ------------------------------------------------------------------ boosting

def fit_boosting(rows: DataFrame, key: str, features: list[str], target: str, rounds: int, step: float = 0.05,
                 depth: int = 5, patience: int | None = None, leaves: int | None = None, l2: float = 1.0,
                 min_rows: int = 1, subsample: float = SUBSAMPLE, colsample: float = COLSAMPLE, bins: int = 32,
                 seed: int = GBT_SEED) -> Boosted:
    """Boosted trees on ``rows``, whose ``role`` is fit, valid or test.

    ``subsample`` of the fit rows (by a hash of the row's number) and
    ``colsample`` of the features (by the seed) serve each round.  A family
    stops after ``patience`` rounds without a lower squared error on its valid
    rows and predicts with its best round; without patience, or for a family
    without valid rows, all rounds count.  Families without fit rows are left
    out, rows without a target serve as test rows only.

    The binned rows stay in the executors as arrays.  A level of a round is one
    job: tasks sum their rows by (family, node, feature, bin), the sums meet by
    family and node and give the best cut.  Only the cuts of the current trees
    and the errors of the families come to the driver; the trees go to a table in
    the checkpoint folder, the rows' state is checkpointed every KEEP_EVERY rounds.
    """
    spark = rows.sparkSession
    y = F.col(target).cast("double")
    rows = rows.withColumn("role", F.when(y.isNull(), TEST).otherwise(F.col("role")))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        # read back from Parquet: a checkpointed frame would claim the partitioning its plan had
        df.write.mode(mode).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    cuts = stored(quantile_cuts(rows.filter(F.col("role") == FIT), key, features, target, bins), "cuts")
    own = list(rows.columns)
    data = stored(rows.join(cuts, key).withColumn("bins", binned(rows, features))
                  .withColumn("_id", F.monotonically_increasing_id()).drop("cuts"), "data")
    key_type = T.StructField(key, rows.schema[key].dataType)
    tree_schema = T.StructType([key_type, *T._parse_datatype_string(f"splits map<int,{SPLIT}>, round int").fields])
    families = [k for k, in cuts.filter(F.col(key).isNotNull()).select(key).collect()]
    parts = _parts(data.count(), spark.sparkContext.defaultParallelism)
    sums = min(parts, max(1, len(families)))
    role = F.when(F.col("role") == FIT, 0).when(F.col("role") == VALID, 1).otherwise(2)
    blocks = _row_blocks(data.select(key, "_id", role.alias("_role"), y.alias("_y"), F.xxhash64("_id", F.lit(seed)).alias("_h"),
                                     "bins", "base"), key, len(features), bins, parts).persist(StorageLevel.MEMORY_AND_DISK)
    take = max(1, int(colsample * len(features)))
    chosen_of = {r: c for r, c in spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("_round"))
                 .select("_round", _chosen(len(features), take, seed)).collect()} if families else {}

    def cut_nodes(blocks: RDD, trees: dict, level: int, r: int, active: set, chosen: list[int]) -> tuple[dict, dict]:
        """({key: {node: split}} of one level, {key: error of the valid rows}); the errors at level 0 only."""
        def sums_of(part):
            for k, block in part:
                if level == 0:
                    valid = block.role == 1
                    if valid.any():
                        yield (k, 0), np.array([((block.y - block.pred)[valid] ** 2).sum(), valid.sum()])
                if k in active and (level == 0 or k in trees):
                    for v, cells in _cells(block, trees.get(k, {}), level, r, subsample, chosen, bins):
                        yield (k, v), cells

        def judged(kv):
            (k, v), cells = kv
            return k, v, (float(cells[0] / cells[1]) if v == 0 else _best_cut(cells, chosen, l2, min_rows))

        found, errors = {}, {}
        for k, v, got in blocks.mapPartitions(sums_of).reduceByKey(np.add, sums).map(judged).collect():
            if v == 0:
                errors[k] = got
            elif got is not None:
                found.setdefault(k, {})[v] = got
        return found, errors

    state = {k: (0, None) for k in families}            # best round and its error
    active, improved, written, held = set(families), set(), False, []

    def judge(r: int, errors: dict) -> None:
        """The errors after round ``r`` move the state of the families that still learn."""
        improved.clear()
        for k in list(active):
            e, (best_round, best_error) = errors.get(k), state[k]
            if patience is None or e is None or best_error is None or e < best_error or (best_error != best_error and e == e):
                state[k] = (r, e)
                improved.add(k)
            elif r - best_round >= patience:
                active.discard(k)

    def keep(trees: list) -> None:
        if trees:
            spark.createDataFrame(trees, tree_schema, verifySchema=False).write.mode("append").parquet(f"{folder}/trees")

    def move(blocks: RDD, trees: dict) -> RDD:
        better = set(improved)
        return blocks.map(lambda kb: (kb[0], _moved(kb[1], trees.get(kb[0], {}), kb[0] in better, depth, step, l2)))

    last = 0
    for r in range(1, rounds + 1):
        chosen = list(chosen_of.get(r, []))
        trees, errors = cut_nodes(blocks, {}, 0, r, active, chosen)
        if last:
            before.unpersist()
            judge(last, errors)
        if not active:
            break
        trees = {k: t for k, t in trees.items() if k in active}
        for level in range(1, depth):
            more = cut_nodes(blocks, trees, level, r, active, chosen)[0] if trees else {}
            if not more:
                break
            for k, splits in more.items():
                trees[k] |= splits
        if leaves is not None:
            trees = {k: {v: t[v] for v in best_first({v: s[2] for v, s in t.items()}, leaves)} for k, t in trees.items()}
        held += [(k, t, r) for k, t in trees.items() if t]
        before, blocks = blocks, move(blocks, trees).persist(StorageLevel.MEMORY_AND_DISK)
        if r % KEEP_EVERY == 0:
            blocks.checkpoint()
            keep(held)
            written, held = written or bool(held), []
        last = r
    else:
        if last:
            judge(last, cut_nodes(blocks, {}, 0, last, set(), [])[1])
            before.unpersist()
    keep(held)
    scored = spark.createDataFrame(
        move(blocks, {}).flatMap(lambda kb: zip(kb[1].ids.tolist(), kb[1].best.tolist())), "_id long, prediction double", verifySchema=False)
    predictions = stored(data.join(scored, "_id").select(*own, "prediction"), "predictions")
    blocks.unpersist()
    rounds_of = spark.createDataFrame([(k, b, e) for k, (b, e) in state.items()], T.StructType(
        [key_type, T.StructField("best_round", T.IntegerType()), T.StructField("best_error", T.DoubleType())]))
    if written or held:
        trees = spark.read.schema(tree_schema).parquet(f"{folder}/trees")
        trees = trees.join(rounds_of.select(key, "best_round"), key).filter("round <= best_round").drop("best_round")
    else:
        trees = spark.createDataFrame([], tree_schema)
    return Boosted(predictions, trees, cuts, rounds_of, step, l2, depth)


def _chosen(n: int, take: int, seed: int) -> Column:
    """``take`` of ``n`` features for the row's ``_round``, by a hash of seed, round and feature."""
    return F.expr(f"array_sort(transform(slice(array_sort(transform(sequence(0, {n - 1}), "
                  f"f -> struct(xxhash64({seed}, _round, f) as h, f as f))), 1, {take}), x -> x.f))")


def predict_boosting(model: Boosted, df: DataFrame, key: str, features: list[str], out: str = "prediction") -> DataFrame:
    """Score other rows: the family's base value and one leaf of each tree; unknown families are dropped.

    Rows are summed by a number of their own, so equal rows stay apart.
    """
    rows = materialize(df.join(model.cuts, key).withColumn("bins", binned(df, features))
                       .withColumn("_id", F.monotonically_increasing_id()).drop("cuts"))
    leaves = (rows.select(key, "_id", "bins").join(model.trees, key).withColumn("node", _node(model.depth))
              .groupBy("_id").agg(F.sum(_leaf_value(model.step, model.l2)).alias("_sum")))
    return (rows.join(leaves, "_id", "left").withColumn(out, F.col("base") + F.coalesce("_sum", F.lit(0.0)))
            .select(*df.columns, out))


def split_importance(model: Boosted, key: str, features: list[str]) -> DataFrame:
    """(key, feature, gain): the share of each feature in the gains of its family's trees."""
    names = F.array(*[F.lit(f) for f in features])
    gains = (model.trees.select(key, F.explode("splits").alias("node", "s"))
             .groupBy(key, F.get(names, F.col("s.f")).alias("feature")).agg(F.sum("s.gain").alias("gain")))
    total = gains.groupBy(key).agg(F.sum("gain").alias("total"))
    return gains.join(total, key).select(key, "feature", (F.col("gain") / F.col("total")).alias("gain"))
