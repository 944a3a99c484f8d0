"""Scalar helpers with the reference's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillcast.constants import INVALID_FAMILY_PREFIX, VALID_FAMILY_PATTERN


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_gap(end: str | Column, start: str | Column) -> Column:
    """``DATEDIFF(end, start)`` in days."""
    return F.datediff(_c(end), _c(start))


def cap_at(x: str | Column, threshold: float | Column) -> Column:
    """X11: values above the threshold become the threshold; null stays null."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(_c(x) > t, t).otherwise(_c(x))


def clip_zero(x: str | Column) -> Column:
    """Negative values become 0; null and NaN stay as they are."""
    return F.when(_c(x) < 0, F.lit(0.0)).otherwise(_c(x))


def revenue(prix: str | Column = "Prix", quantite: str | Column = "Quantite") -> Column:
    """X13."""
    return _c(prix) * _c(quantite)


def round_to(x: str | Column, digits: int) -> Column:
    """X14 + N11: round a double to ``digits`` decimals as ``round(x * 10^d) / 10^d``
    (half away from zero on the binary value; the reference mixes Python's
    half-even and MySQL's half-up, which differ only on exact ties).  Spark's ``round`` rounds the
    shortest decimal text of the double instead, which differs from other
    engines on values such as 1060.2115625; this form gives the same bits as
    DuckDB's ``round``."""
    m = float(10 ** digits)
    return F.round(_c(x).cast("double") * m, 0) / m


def pct(part: str | Column, whole: str | Column, digits: int = 2) -> Column:
    """X14 + N9 + N12: ``round(part * 100 / whole, digits)`` in double; null on /0."""
    return round_to(F.try_divide(_c(part).cast("double") * 100.0, _c(whole).cast("double")), digits)


def valid_family(c: str | Column = "Famille") -> Column:
    """Not null, no leading ``~``, letters (Latin-1 accents), ``/`` and spaces only.

    ``(?U)`` makes ``\\s`` match Unicode spaces such as the no-break space, as
    Python's ``re`` does.
    """
    fam = _c(c)
    return (fam.isNotNull() & ~fam.startswith(INVALID_FAMILY_PREFIX)
            & fam.rlike("(?U)" + VALID_FAMILY_PATTERN))


def sum_or_zero(c: str | Column) -> Column:
    """A sum over only nulls is 0 (pandas), not null (SQL)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0.0))


def parse_date(c: str | Column, fmt: str | None = None) -> Column:
    """Text to date; dirty text gives null instead of raising (ANSI)."""
    if fmt:
        return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("date")
    return _c(c).try_cast("date")
