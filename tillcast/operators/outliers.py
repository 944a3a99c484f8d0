"""Outlier capping (G22, X11) and an exact distributed quantile.

``exact_quantiles`` gives pandas' ``quantile`` (linear interpolation) without
sorting the column and in two scans, however many quantiles and columns are
asked for.  The first scan is one mergeable sketch per column
(``percentile_approx``), whose rank error gives an interval round each wanted
rank.  The second counts the values in the intervals one by one and all other
rows only in sum, so it shuffles a few thousandths of the rows at most and a
heavy value is one row.  Those counts are cut into value ranges; prefix sums
of the totals of the ranges find the range of each rank, and only these ranges
are ordered.  The driver receives one row per range and one per wanted rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.scalars import cap_at
from tillcast.session import materialize


def percentile_column(df: DataFrame, value: str, p: float) -> DataFrame:
    """One-row frame with the exact ``p`` quantile of ``value`` (linear).

    For frames with a bounded number of rows per distinct value set (a daily
    series has one row per day) the exact ``percentile`` aggregate is used.
    """
    return df.agg(F.percentile(F.col(value).cast("double"), F.lit(p)).alias("threshold"))


def cap_series(series: DataFrame, value: str = "Quantite", p: float = 0.99,
               out_col: str | None = None) -> DataFrame:
    """G22 + X11: add ``<value>_capped`` = min(value, p-quantile), nulls kept.

    The quantile is a one-row frame joined by broadcast (one row: a proven
    size bound), so the whole step is one plan.
    """
    out_col = out_col or f"{value}_capped"
    t = percentile_column(series, value, p)
    return (series.crossJoin(F.broadcast(t))
            .withColumn(out_col, cap_at(F.col(value).cast("double"), F.col("threshold")))
            .drop("threshold"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], max_values: int = 1_000_000,
                    accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles (linear interpolation between order statistics) of a
    column of any size.  Nulls and NaN are ignored, as pandas does; a column
    without values gives None for each."""
    return exact_quantiles_multi(df, {col: probs}, max_values, accuracy)[col]


def exact_quantiles_multi(df: DataFrame, wanted: dict[str, list[float]], max_values: int = 1_000_000,
                          accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """:func:`exact_quantiles` for several columns, in the same two scans."""
    return quantiles_and_aggregates(df, wanted, [], max_values, accuracy)[0]


def quantiles_and_aggregates(df: DataFrame, wanted: dict[str, list[float]], aggs: list[Column],
                             max_values: int = 1_000_000, accuracy: int = 10_000):
    """``(quantiles by column, row of aggs)``: any named aggregates of ``df``
    ride along with the first of the two scans."""
    x = {c: F.col(c).cast("double") for c in wanted}
    x = {c: F.when(~F.isnan(v), v) for c, v in x.items()}
    margin = 3.0 / accuracy
    ends = {c: sorted({min(max(p + s * margin, 0.0), 1.0) for p in ps for s in (-1, 1)}) for c, ps in wanted.items()}
    names = {c: i for i, c in enumerate(wanted)}
    first = df.agg(*aggs, *[F.count(x[c]).alias(f"_n{i}") for c, i in names.items()],
                   *[F.percentile_approx(x[c], F.array(*[F.lit(e) for e in ends[c]]), accuracy).alias(f"_q{i}")
                     for c, i in names.items() if ends[c]]).first()
    ranks, cuts, inside = {}, {}, 0.0
    for c, i in names.items():
        n = first[f"_n{i}"]
        if not n or not wanted[c]:
            continue
        at = dict(zip(ends[c], first[f"_q{i}"]))
        ranks[c] = sorted({r for p in wanted[c] for r in _neighbours(n, p)})
        if n <= accuracy:         # an interval round a rank needs more than one row a step: count every value
            cuts[c] = [(-math.inf, math.inf)]
            continue
        cuts[c] = _merged([(-math.inf if p <= margin else at[max(p - margin, 0.0)],
                            math.inf if p + margin >= 1 else at[min(p + margin, 1.0)]) for p in wanted[c]])
        inside += 2 * margin * n * len(wanted[c])
    values = _values_at(df, x, cuts, ranks, int(inside // max_values) + 1)
    missed = {c: [r for r in rs if (c, r) not in values] for c, rs in ranks.items()}
    missed = {c: rs for c, rs in missed.items() if rs}
    if missed:                # beyond the error the sketch promises: count every value of these columns
        rows = sum(first[f"_n{names[c]}"] for c in missed)
        values |= _values_at(df, x, {c: [(-math.inf, math.inf)] for c in missed}, missed, rows // max_values + 1)

    out = {}
    for c, i in names.items():
        n, out[c] = first[f"_n{i}"], []
        for p in wanted[c]:
            if not n:
                out[c].append(None)
                continue
            lo, hi = _neighbours(n, p)
            a, b = values[c, lo], values[c, hi]
            out[c].append(a if a == b else a + (b - a) * ((n - 1) * p - lo))
    return out, first


def _neighbours(n: int, p: float) -> tuple[int, int]:
    """Ranks (from 0) of the two order statistics that quantile ``p`` of n values lies between."""
    return math.floor((n - 1) * p), math.ceil((n - 1) * p)


def _merged(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed intervals as disjoint ones, ascending."""
    out = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _values_at(df: DataFrame, x: dict[str, Column], cuts: dict[str, list[tuple[float, float]]],
               ranks: dict[str, list[int]], parts: int) -> dict[tuple[str, int], float]:
    """``{(column, rank): value}`` for the wanted ranks that fall into the intervals ``cuts``.

    One scan counts the values in the intervals one by one and the rows between
    the intervals in sum (segments, numbered in value order: odd ones are
    intervals).  The counts are cut into ``parts`` ranges; the totals of the
    ranges say where each rank lies, and only those ranges are ordered.
    """
    cols = list(cuts)
    if not cols:
        return {}
    records = []
    for i, c in enumerate(cols):
        seg = F.lit(2 * len(cuts[c]))
        for j, (lo, hi) in reversed(list(enumerate(cuts[c]))):
            seg = F.when(x[c] < F.lit(lo), 2 * j).when(x[c] <= F.lit(hi), 2 * j + 1).otherwise(seg)
        records.append(F.when(x[c].isNotNull(), F.struct(
            F.lit(i).alias("ci"), seg.alias("seg"), F.when(seg % 2 == 1, x[c]).alias("x"))))
    counts = (df.select(F.explode(F.array(*records)).alias("r")).filter(F.col("r").isNotNull())
              .select("r.*").groupBy("ci", "seg", "x").agg(F.count(F.lit(1)).alias("nb")))
    ranged = materialize(counts.repartitionByRange(parts, "ci", "seg", "x")
                         .withColumn("part", F.spark_partition_id()))
    # at most one row per range and one per segment
    totals = (ranged.groupBy("ci", "seg", "part").agg(F.sum("nb").alias("nb"))
              .orderBy("ci", "seg", "part").collect())
    before, places = {}, []
    for t in totals:
        start = before.get(t["ci"], 0)
        before[t["ci"]] = start + t["nb"]
        if t["seg"] % 2:
            places += [(t["ci"], t["seg"], t["part"], r, r - start) for r in ranks[cols[t["ci"]]]
                       if start <= r < start + t["nb"]]
    if not places:
        return {}
    wanted = df.sparkSession.createDataFrame(places, "ci int, seg int, part int, rank long, place long")
    keys = ["ci", "seg", "part"]
    upto = F.sum("nb").over(Window.partitionBy(*keys).orderBy("x"))
    # one row per wanted rank on the broadcast side
    found = (ranged.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
             .withColumn("upto", upto).join(F.broadcast(wanted), keys)
             .filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("nb") <= F.col("place"))))
    return {(cols[r["ci"]], r["rank"]): r["x"] for r in found.select("ci", "rank", "x").collect()}
