"""Feature coercion and standard scaling (pr8, pr9, a13, a14).

The scaler's statistics are one global aggregate: exactly one row (two
numbers per feature) whatever the data size.  As in a Spark ML scaler, the
fit returns that row and the transform applies it as literals: no join, and
the scaling stays a projection inside the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import finite_or_zero, numeric_or_zero


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each present column as double; unparsable or null becomes 0.0 (pr8)."""
    return df.withColumns({c: numeric_or_zero(c) for c in cols if c in df.columns})


def finite_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and +-inf become 0.0 (pr9)."""
    return df.withColumns({c: finite_or_zero(c) for c in cols if c in df.columns})


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``mean_<c>`` and ``scale_<c>`` (population std, 1 when it is 0) (a13)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"mean_{c}"))
        aggs.append(F.stddev_pop(c).alias(f"std_{c}"))
    st = df.agg(*aggs)
    return st.select(*[F.col(f"mean_{c}") for c in cols], *[
        F.when(F.col(f"std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"std_{c}")).alias(f"scale_{c}")
        for c in cols])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """``(c - mean) / scale`` with the fitted one-row statistics (a14); the
    row is read once (2 numbers per feature) and applied as literals."""
    st = stats.first().asDict()
    scaled = {c: (F.col(c) - F.lit(st[f"mean_{c}"])) / F.lit(st[f"scale_{c}"]) for c in cols}
    return df.withColumns(scaled)
