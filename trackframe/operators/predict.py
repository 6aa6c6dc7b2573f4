"""Closed-form predictors and prediction post-processing (f28-f30, pr12, m6).

All are projections over keyed rows: a prediction always carries its ``id``
(and the play key), so nothing depends on row order.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import clip
from trackframe.sources.tracking import PLAY

# Field size in yards, field centre used as the fallback,
# seconds per frame.
FIELD_LENGTH = 120.0
FIELD_WIDTH = 53.3
CENTRE_X, CENTRE_Y = 50.0, 26.65
FRAME_SECONDS = 0.1


def clip_to_field(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x into [0, 120], y into [0, 53.3]; null stays null (pr12)."""
    return df.withColumns({x: clip(x, 0.0, FIELD_LENGTH), y: clip(y, 0.0, FIELD_WIDTH)})


def physics_columns(df: DataFrame) -> tuple[F.Column, F.Column]:
    """Constant-velocity projection from the last input state (f28).

    ``x_input + s cos(dir) * 0.1 * frame_id`` (angle convention of family A).
    Per row, a missing speed or direction falls back to the last position and
    a missing position to the field centre.
    """
    cols = set(df.columns)
    px: list[F.Column] = []
    py: list[F.Column] = []
    has_pos = {"x_input", "y_input"} <= cols
    if has_pos and {"s_input", "dir_input"} <= cols:
        dt = FRAME_SECONDS * F.col("frame_id")
        rad = F.radians(F.col("dir_input"))
        px.append(F.col("x_input") + F.col("s_input") * F.cos(rad) * dt)
        py.append(F.col("y_input") + F.col("s_input") * F.sin(rad) * dt)
    if has_pos:
        px.append(F.col("x_input"))
        py.append(F.col("y_input"))
    px.append(F.lit(CENTRE_X))
    py.append(F.lit(CENTRE_Y))
    return F.coalesce(*px), F.coalesce(*py)


def physics_baseline(samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed physics predictions (id, x, y, fallback) clipped to the field (f28, f29).

    ``fallback`` marks rows that got a coordinate of the field centre because their player's input state lacks it.
    """
    px, py = physics_columns(samples)
    has_pos = "x_input" in samples.columns
    fallback = (F.col("x_input").isNull() | F.col("y_input").isNull()) if has_pos else F.lit(True)
    keys = [c for c in PLAY if c in samples.columns]
    out = samples.select("id", *keys, *keep, px.alias("x"), py.alias("y"), fallback.alias("fallback"))
    return clip_to_field(out)


def zero_baseline(rows: DataFrame) -> DataFrame:
    """Constant zero prediction (f30), the floor in any model comparison."""
    keys = [c for c in PLAY if c in rows.columns]
    return rows.select("id", *keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def blend_columns(members: dict[str, tuple[F.Column, F.Column]], weights: dict[str, float]) -> tuple[F.Column, F.Column]:
    """The mean of ``blend`` for members that are columns of one row: a projection, no shuffle (m6)."""
    def mean(axis: int) -> F.Column:
        parts = [(float(weights.get(name, 0.0)), xy[axis]) for name, xy in members.items()]
        total = reduce(add, [F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts])
        return F.try_divide(reduce(add, [F.coalesce(w * c, F.lit(0.0)) for w, c in parts]), total)
    return mean(0), mean(1)


def blend(members: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of member predictions per id, normalised over present members (m6).

    Members are stacked (union) and reduced with one grouped aggregate on the
    id, so a member that has no row (or a null) for an id does not pull that
    prediction toward zero.
    """
    # the id determines the play; grouping on both keeps the play partitioning
    keys = ["id"] + [k for k in PLAY if all(k in df.columns for df in members.values())]
    stacked = None
    for name, df in members.items():
        w = float(weights.get(name, 0.0))
        part = df.select(*keys, F.lit(w).alias("w"), "x", "y")
        stacked = part if stacked is None else stacked.unionByName(part)
    wx = F.when(F.col("x").isNotNull(), F.col("w"))
    wy = F.when(F.col("y").isNotNull(), F.col("w"))
    return stacked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum(wx)).alias("x"),
        F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum(wy)).alias("y"),
    )
