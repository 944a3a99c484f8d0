"""Secret scanning with corpus-wide ownership, as DataFrame operations only.

Three patterns give the base spans.  Longer mixed tokens are candidates beside
them: a candidate is reported if its value belongs to few owners and to few
repositories of each, since a value that many owners hold, or many repositories
of one, is a copied example and one of few looks live.  Base spans are reported anyway, with the same
judgement of their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import written

# fixed values: the patterns of the kinds, in their order
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", "mixed")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: int, pattern: str, value: str, good: str) -> str:
    """SQL array of struct(kind, i, skip, size, good, value_key) of a pattern's matches in ``text``.

    The pieces between matches (``split``) and the matches themselves
    (``regexp_extract_all``) alternate: ``skip`` and ``size`` are their lengths
    in code points, so that running sums give the positions.  ``value`` is SQL
    over the match ``m``, ``good`` over that value ``v``.
    """
    q = _quoted(pattern)
    return (f"transform(array(regexp_extract_all(text, {q}, 0)), found -> transform("
            f"zip_with(slice(split(text, {q}, -1), 1, size(found)), found, (p, m) -> "
            f"named_struct('skip', length(p), 'size', length(m), 'v', {value})), (x, i) -> "
            f"named_struct('kind', {kind}, 'i', i, 'skip', x.skip, 'size', x.size, "
            f"'good', {good.format('x.v')}, 'value_key', xxhash64(x.v))))[0]")


def found_matches(docs: DataFrame) -> DataFrame:
    """``(row_id, doc_id, owner, found)``: the matches of all kinds in one array."""
    kinds = [_matches(0, ASSIGN, f"regexp_extract(m, {_quoted(ASSIGN)}, 1)", "length({0}) >= 6"),
             _matches(1, ACCESS, "m", "true"), _matches(2, HEX, "m", "true"),
             _matches(3, MIXED, "m", "({0} rlike '[0-9]' and {0} rlike '[a-z]' and {0} rlike '[A-Z]')")]
    return docs.select("row_id", "doc_id", "owner", F.expr(f"concat({', '.join(kinds)})").alias("found"))


def placed_spans(found: DataFrame) -> DataFrame:
    """One row per match with ``start`` and ``end``; ``good`` is false for matches that do not count.

    Positions are running sums in each text and kind.  A mixed candidate gives
    way to base spans: one that starts at or before it and ends after its start
    (a running maximum), or one that starts inside it (a running minimum from
    the end).  Every text is swept in order, so the work grows with its matches.
    """
    each = found.filter(F.size("found") > 0).select("row_id", "doc_id", "owner", F.inline("found")).repartition("row_id")
    up_to_here = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (each.withColumn("end", F.sum(F.col("skip") + F.col("size")).over(up_to_here).cast("int"))
              .withColumn("start", F.col("end") - F.col("size")))
    base = F.col("good") & (F.col("kind") < 3)
    text = Window.partitionBy("row_id")
    ahead = text.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = (F.coalesce(F.max(F.when(base, F.col("end"))).over(ahead) > F.col("start"), F.lit(False))
           | F.coalesce(F.min(F.when(base, F.col("start"))).over(back) < F.col("end"), F.lit(False)))
    return (placed.withColumn("met", met)
            .select("row_id", "doc_id", "owner", "kind", "start", "end", "value_key",
                    (F.col("good") & ((F.col("kind") < 3) | ~F.col("met"))).alias("good")))


def ownership(candidates: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """``(value_key, n_repos, n_owners, example)`` of ``candidates(value_key, repo, owner)``.

    ``n_repos`` is the largest number of repositories that one owner has the
    value in.  Null owners count for neither.  Distinct repositories and owners are counted from one row for each value,
    owner and repository, merged before they are shuffled, so a value that a
    third of all rows hold is no hot row.
    """
    by_owner = (candidates.distinct().groupBy("value_key", "owner").agg(F.count("repo").alias("repos")))
    return (by_owner.groupBy("value_key").agg(F.max(F.expr("if(owner is null, 0, repos)")).alias("n_repos"),
                                            F.count("owner").alias("n_owners"))
            .withColumn("example", (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)))


def scan(docs: DataFrame, owner: str = "source", example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """One row per input row: base counts and spans, and the spans that ownership adds.

    Columns: doc_id, n_assign, n_access, n_hex, base (string of
    ``kind:start:end`` by start, then kind, comma-joined; code points, end
    exclusive), spans (base and added, joined likewise), n_example and n_live
    (spans whose value is a widely copied example or owner-specific).  A
    repository is a document and an owner is the ``owner`` column's value;
    a value held by ``example_owners`` owners or more, or by ``example_repos``
    repositories or more of one owner, is an example.  ``mixed``
    candidates (32 or more letters, digits and ``+/_-`` with a digit, a capital
    and a small letter, overlapping no base span) are added if they are no
    example.  Null and empty texts have no spans; null owners are one owner
    that counts for nothing; rows that repeat a doc_id are judged each.  An
    empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col(owner).cast("string").alias("owner"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = written(found_matches(base.withColumn("row_id", F.monotonically_increasing_id())), "matches")
    spans = written(placed_spans(kept), "spans")
    examples = (ownership(spans.filter("good").select("value_key", F.col("doc_id").alias("repo"), "owner"),
                          example_owners, example_repos).filter("example").select("value_key", "example"))
    span = F.when(F.col("good"), F.struct("start", "kind", "end", F.coalesce("example", F.lit(False)).alias("example")))
    found = (spans.join(examples, "value_key", "left").groupBy("row_id", "doc_id")
             .agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row_id"))
    none = kept.filter(F.size("found") == 0).select(
        "doc_id", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,example:boolean>>)").alias("spans"))

    def names(which: str) -> str:
        kinds = "array('assign', 'access', 'hex', 'mixed')"
        return f"array_join(transform(filter(spans, x -> {which}), x -> concat_ws(':', {kinds}[x.kind], x.start, x.end)), ',')"

    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.unionByName(none).select(
        "doc_id", *counts, F.expr(names("x.kind < 3")).alias("base"),
        F.expr(names("x.kind < 3 or not x.example")).alias("spans"),
        F.expr("cast(size(filter(spans, x -> x.example)) as bigint)").alias("n_example"),
        F.expr("cast(size(filter(spans, x -> not x.example)) as bigint)").alias("n_live"))
