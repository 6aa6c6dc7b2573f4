"""Column helpers that keep the tabular (NaN-propagating) semantics of the
feature definitions while staying native Spark expressions.

Spark's ``least``/``greatest`` skip nulls, ``%`` truncates toward zero,
comparisons with null give null and ``max_by`` returns the value of the
maximal row even when that value is null.  The helpers below restate the
intended semantics explicitly so no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_null(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def nan_least(*cols: ColumnOrName) -> Column:
    """Element-wise minimum that is null when any input is null (n2)."""
    cs = [col(c) for c in cols]
    return F.when(~_any_null(cs), F.least(*cs))


def nan_greatest(*cols: ColumnOrName) -> Column:
    """Element-wise maximum that is null when any input is null (n2)."""
    cs = [col(c) for c in cols]
    return F.when(~_any_null(cs), F.greatest(*cs))


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; a null stays null."""
    out = col(c)
    if lo is not None:
        out = nan_greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = nan_least(out, F.lit(float(hi)))
    return out


def flag(predicate: Column) -> Column:
    """Boolean predicate as a 0/1 integer, null/unknown counts as 0 (n3)."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def floor_mod(c: ColumnOrName, m: float) -> Column:
    """Floored modulo: the result has the divisor's sign (n4)."""
    return F.pmod(col(c), F.lit(float(m)))


def diff_filled(c: ColumnOrName, window) -> Column:
    """``c - lag(c)`` with 0 for the first row or any null side (n6)."""
    cc = col(c)
    return F.coalesce(cc - F.lag(cc, 1).over(window), F.lit(0.0))


def last_non_null(c: str, order: str = "frame_id") -> Column:
    """Value of ``c`` at the greatest ``order`` among rows where ``c`` is not null (n1)."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def finite_or_zero(c: ColumnOrName) -> Column:
    """Null, NaN and +-inf become 0.0 (pr9)."""
    cc = col(c).cast("double")
    return F.when(cc.isNull() | F.isnan(cc) | (F.abs(cc) == float("inf")), F.lit(0.0)).otherwise(cc)


def numeric_or_zero(c: ColumnOrName) -> Column:
    """Coerce to double; anything unparsable or null becomes 0.0 (pr8)."""
    return F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str)
                      else col(c).try_cast("double"), F.lit(0.0))
