"""URL filter rules held in Bloom filter cascades.

A rule is a host and a path prefix; its key is the two joined.  A url is asked
for the keys of its host and the hosts above it with the prefixes of its path.
Level 1 of a cascade encodes the listed keys, level 2 those keys of the corpus
that level 1 takes for listed but are not, level 3 the listed keys that level 2
takes for such, and so on until a level makes no mistake.  Over the corpus's
complete key universe the answer is then exact, and no url is joined with
anything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str     # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path)``; both are empty where the url is null or has no ``://``."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
            .select("page_id", F.regexp_extract(rest, r"^([^?#]*)", 1).alias("rest"))
            .select("page_id", F.translate(F.substring_index("rest", "/", 1), UPPER, LOWER).alias("host"),
                    F.expr("if(instr(rest, '/') > 0, substring(rest, instr(rest, '/')), '')").alias("path")))


def _keys(lengths: list[int]) -> Column:
    """Keys that a url may be listed under, longest first (of one length, the longer host first).

    They are the host and the hosts above it, by the path's prefixes; only
    prefixes as long as a listed path are asked for.
    """
    labels = "split(host, '[.]')"
    hosts = f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))"
    sizes = f"array({', '.join(map(str, lengths))})"
    keys = (f"flatten(transform({hosts}, h -> transform(filter({sizes}, n -> n <= length(path)), "
            "n -> struct(-(length(h) + n) as shorter, -length(h) as shorter_host, concat(h, left(path, n)) as key))))")
    return F.expr(f"transform(array_sort({keys}), k -> k.key)")


class Level:
    """A Bloom filter for ``n`` keys: 64-bit words, made and asked as Spark expressions."""

    def __init__(self, keys: DataFrame, n: int, mistakes: float, number: int):
        self.hashes, self.number = max(1, round(-math.log2(mistakes))), number
        self.bits = 64 * max(1, math.ceil(n * self.hashes / math.log(2) / 64))
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("place"))
        words = places.groupBy(F.expr("cast(place div 64 as int)").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
        self.words = [0] * (self.bits // 64)
        for word, bits in words.collect():               # at most the filter's words
            self.words[word] = bits

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(k)), F.lit(self.bits).cast("long"))
                for k in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words])
        return reduce(Column.__and__, [
            F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
            for p in self._places(key)])


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (see the module)."""

    def __init__(self, listed: list[str], universe: DataFrame, universe_size: int):
        spark = universe.sparkSession
        self.levels: list[Level] = []
        if not listed:
            return
        inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        n = inside.count()
        mistakes = min(0.5, max(n / max(1, universe_size), 2.0 ** -20))
        outside = universe
        while n:
            level = Level(inside, n, mistakes, len(self.levels))
            self.levels.append(level)
            if len(self.levels) == 1:
                # the level's size makes about as many mistakes as there are listed keys
                outside = written(universe.filter(level.has(F.col("key"))).distinct()
                                  .join(inside, "key", "left_anti"), "mistakes")
            else:
                outside = outside.filter(level.has(F.col("key")))
            inside, outside = outside, inside
            n, mistakes = inside.count(), 0.5

    def has(self, key: Column) -> Column:
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = level.has(key) & ~answer
        return answer


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", most_rules: int = 200_000) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per input row.

    ``host`` is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; ``path`` goes on up to ``?`` or ``#``.  Both are
    empty where the url is null or has no ``://``.  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins, of equals
    the one with the longer host.  ``rule`` is its key, or null; ``verdict`` is
    the rule's or ``default``, as an unlisted url is in no list.  A key listed
    with both verdicts is blocked.  The list is a parameter of at most
    ``most_rules`` rules, which bounds the filters (about 2 to 4 bytes a rule).
    """
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; the filters are sent to all tasks, so at most {most_rules} are taken")
    base = parsed(pages)
    lengths = sorted({len(r.path) for r in rules}) or [0]
    keys = _keys(lengths)
    universe = base.select(F.explode_outer(keys).alias("key")).filter("key is not null")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    blocked = Cascade([r.key for r in rules if r.verdict == "block"], universe, size)
    allowed = Cascade([r.key for r in rules if r.verdict == "allow"], universe, size)
    found = base.withColumn("rule", F.get(F.filter(keys, lambda k: blocked.has(k) | allowed.has(k)), F.lit(0)))
    return found.select("page_id", "host", "path", "rule",
                        F.when(F.col("rule").isNull(), default)
                        .when(blocked.has(F.col("rule")), "block").otherwise("allow").alias("verdict"))


def oracle(rules: list[Rule]) -> str:
    """DuckDB twin of ``judge``: every url against every rule."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
with rules(verdict, host, path) as (values {values}),
rest as (
  select page_id, case when contains(url, '://')
    then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
parsed as (
  select page_id, translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') as host,
         case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end as path from rest),
hits as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
         row_number() over (partition by p.page_id order by length(r.host || r.path) desc) as n
  from parsed p left join rules r
  on (p.host = r.host or suffix(p.host, '.' || r.host)) and prefix(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hits where n = 1
"""
