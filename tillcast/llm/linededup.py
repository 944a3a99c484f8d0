"""Line deduplication by winnowed line fingerprints, as DataFrame operations only.

Lines are hashed, ``gram`` consecutive line hashes make a gram, and of every
``window`` consecutive grams the smallest is a fingerprint (winnowing), so any
two equal runs of ``window + gram - 1`` lines share a fingerprint at the same
place.  Every run of that guaranteed length is kept with its own hash and the
fingerprint it chose; runs whose fingerprint has one place are dropped, the
others are grouped by their hash, and runs that stand earlier in the corpus as
well are deleted.  Longer repeats are unions of such runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import written


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once.

    A column that a lambda refers to would be put in its place and worked out
    for every element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


_SOLID = "trim({}) <> ''"


def _runs(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """``(doc_id, text_key, fp, place, start, run_a, run_b)``: every run with the fingerprint it chose."""
    run = gram + window - 1

    def upto(n: int) -> str:      # first lines of the stretches of n lines
        return f"filter(sequence(1, greatest(size(h), 1)), i -> i <= size(h) - {n - 1})"

    # the fingerprint of the run that starts at line i: its smallest gram, the last one of equals
    runs = _let("x", f"filter(split(text, '\\n', -1), y -> {_SOLID.format('y')})",
                _let("h", "transform(x, y -> xxhash64(trim(y)))",
                     _let("k", "transform(x, y -> xxhash64(trim(y), 'second'))",
                          _let("g", f"transform({upto(gram)}, i -> struct(xxhash64(slice(h, i, {gram})) as fp, -i as back))",
                               f"transform({upto(run)}, i -> struct(array_min(slice(g, i, {window})) as least, "
                               f"i as start, xxhash64(slice(h, i, {run})) as run_a, xxhash64(slice(k, i, {run})) as run_b))"))))
    # the outer form, as the inner one is preceded by a filter that works the array out once more
    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode_outer(F.expr(runs)).alias("r"))
            .filter("r is not null").select("doc_id", "text_key", F.col("r.least.fp").alias("fp"), F.expr("-r.least.back").alias("place"),
                    "r.start", "r.run_a", "r.run_b"))


def _passages(docs: DataFrame, most: int, words: int) -> DataFrame:
    """``(doc_id, text_key, start, lines, whole, run_a, run_b)``: runs of ``most`` or fewer lines that hold ``words`` words.

    The lines of a document of ``most`` or fewer lines are one more run, marked ``whole``.
    """
    def run(i: str, n: str, whole: str) -> str:
        return (f"struct({i} as start, {n} as lines, {whole} as whole, xxhash64(slice(h, {i}, {n})) as run_a, "
                f"xxhash64(slice(k, {i}, {n})) as run_b)")

    long = [f"transform(filter(sequence(1, greatest(size(h), 1)), i -> i <= size(h) - {n - 1} and "
            f"aggregate(slice(w, i, {n}), 0, (a, b) -> a + b) >= {words}), i -> {run('i', str(n), 'false')})"
            for n in range(1, most + 1)]
    whole = f"transform(filter(array(size(h)), n -> n between 1 and {most}), n -> {run('1', 'n', 'true')})"
    found = _let("x", f"filter(split(text, '\\n', -1), y -> {_SOLID.format('y')})",
                 _let("h", "transform(x, y -> xxhash64(trim(y)))",
                      _let("k", "transform(x, y -> xxhash64(trim(y), 'second'))",
                           _let("w", "transform(x, y -> size(filter(split(y, '\\\\s+'), z -> z <> '')))",
                                f"concat({', '.join([*long, whole])})"))))
    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode_outer(F.expr(found)).alias("r"))
            .filter("r is not null").select("doc_id", "text_key", "r.*"))


def _later(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``placed`` whose ``keys`` stand at a smaller (doc_id, start) as well."""
    first = (placed.groupBy(*keys)
             .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
             .filter("first <> last").select(*keys, "first"))
    return placed.join(first, keys).filter(F.struct("doc_id", "start") > F.col("first"))


def repeated_runs(docs: DataFrame, gram: int = 2, window: int = 2, passage_words: int | None = None) -> DataFrame:
    """``(doc_id, text_key, runs)``: the later copies of runs, by their first line and number of lines.

    Lines count from 1 over a document's lines that are not blank.  A run is a
    later copy if the same lines start at a smaller (doc_id, line) anywhere.
    """
    run = gram + window - 1
    runs = written(_runs(docs, gram, window), "runs")
    # neighbouring runs may choose the same gram: a fingerprint is shared if it has two places
    shared = (runs.groupBy("fp").agg(F.min(F.struct("doc_id", "place")).alias("low"),
                                     F.max(F.struct("doc_id", "place")).alias("high"))
              .filter("low <> high").select("fp"))
    placed = written(runs.join(shared, "fp", "left_semi").drop("fp", "place"), "placed")
    later = _later(placed, ["run_a", "run_b"]).select("doc_id", "text_key", "start", F.lit(run).alias("lines"))
    if passage_words is not None and run > 1:
        passages = written(_passages(docs, run - 1, passage_words), "passages")
        later = later.unionByName(_later(passages, ["lines", "whole", "run_a", "run_b"])
                                  .select("doc_id", "text_key", "start", "lines"))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "lines"))).alias("runs"))


def dedup_lines(docs: DataFrame, gram: int = 2, window: int = 2, passage_words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``.

    A run of at least ``gram + window - 1`` (three) non-blank lines, compared
    without spaces at their ends, is deleted where it also starts earlier,
    in this document or in one with a smaller doc_id.  With ``passage_words``
    the same holds for shorter runs of that many words (parted by white space)
    or more, and for shorter documents all of whose lines are those of an
    earlier document; without it shorter runs stay.  Adds ``n_lines`` (lines
    that are not blank) and ``n_removed``.  Every row stays: a document may
    become empty.  Columns of these names in ``docs`` are replaced.  Blank lines are never part of a run and stay.  A null text
    stays null with counts 0; rows without a doc_id stay as they are and are no
    earlier copy for others; rows with one doc_id and one text are one place,
    so neither is later than the other.  An empty table gives no rows.
    """
    known = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    marks = repeated_runs(known, gram, window, passage_words).select(
        F.col("doc_id").alias("mark_doc"), F.col("text_key").alias("mark_key"), F.col("runs").alias("mark_runs"))
    joined = docs.join(marks, (docs["doc_id"] == F.col("mark_doc")) & (F.xxhash64(docs["text"]) == F.col("mark_key")),
                       "left")
    gone = "array_distinct(flatten(transform(mark_runs, s -> sequence(s.start, s.start + s.lines - 1))))"
    places = "sequence(0, size(x) - 1)"
    kept = _let("x", "split(text, '\\n', -1)",
                _let("p", f"filter({places}, i -> {_SOLID.format('x[i]')})",
                     f"array_join(transform(array_except({places}, transform({gone}, r -> p[r - 1])), i -> x[i]), '\\n')"))
    text = F.when(F.col("mark_runs").isNotNull(), F.expr(kept)).otherwise(F.col("text"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[text.alias(c) if c == "text" else docs[c] for c in own],
        F.expr(f"coalesce(size(filter(split(text, '\\n', -1), y -> {_SOLID.format('y')})), 0)").cast("long").alias("n_lines"),
        F.expr(f"coalesce(size({gone}), 0)").cast("long").alias("n_removed"))


#: DuckDB twin of ``op8_line_dedup``: runs of three lines, and of one or two with 50 words, compared as text.
ORACLE = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents),
solid as (
  select doc_id, i, trim(line) as line,
         len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) as words,
         row_number() over (partition by doc_id order by i) as place,
         count(*) over (partition by doc_id) as n_lines
  from lines where trim(line) <> ''),
near as (
  select doc_id, place, n_lines, line, words, lead(line, 1) over w as second, lead(line, 2) over w as third,
         lead(words, 1) over w as words_2
  from solid window w as (partition by doc_id order by place)),
runs as (
  select doc_id, place, 3 as n, false as whole, [line, second, third] as run from near where third is not null
  union all select doc_id, place, 1, false, [line] from near where words >= 50
  union all select doc_id, place, 2, false, [line, second] from near where second is not null and words + words_2 >= 50
  union all select doc_id, place, n_lines, true, [line, second] from near where n_lines <= 2 and place = 1),
ranked as (
  select doc_id, place, n, row_number() over (partition by n, whole, run order by doc_id, place) as nth from runs),
gone as (select distinct doc_id, place + k as place from ranked, (values (0), (1), (2)) t(k) where nth > 1 and k < n),
counts as (
  select s.doc_id, count(*) as n_lines, count(g.place) as n_removed
  from solid s left join gone g on s.doc_id = g.doc_id and s.place = g.place group by s.doc_id),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text
  from lines l left join solid s on l.doc_id = s.doc_id and l.i = s.i
  left join gone g on s.doc_id = g.doc_id and s.place = g.place
  where g.place is null group by l.doc_id)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_removed, 0) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join counts c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id
"""
