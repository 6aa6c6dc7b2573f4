"""Per-player time-series features over ``Window.partitionBy(player).orderBy(frame)``
(w1-w11).

Frames here are bounded (lags, rolling rows) or running sums (the EMA), so work
per row is constant whatever the length of a player's series.  There is no global
sort (s1): order exists only inside each player's window.  Spark groups all
window expressions with the same specification into one Window operator over
one sort; on input partitioned by the play key there is no exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.geometry import seen_from, turn_to
from trackframe.functions.nulls import diff_filled
from trackframe.operators.direction import wrap_angle_deg
from trackframe.sources.tracking import PLAYER


def player_window(order: str = "frame_id"):
    return Window.partitionBy(*PLAYER).orderBy(order)


def rows_back(n: int, order: str = "frame_id"):
    """The current row and the ``n - 1`` before it."""
    return player_window(order).rowsBetween(-(n - 1), 0)


def lag_features(df: DataFrame, lags=(1, 2, 3, 4, 5),
                 cols=("x", "y", "velocity_x", "velocity_y")) -> DataFrame:
    """``c_lag{k}`` for every k and column present (w1)."""
    w = player_window()
    out = {f"{c}_lag{k}": F.lag(c, k).over(w) for k in lags for c in cols if c in df.columns}
    return df.withColumns(out)


SPAN = 40.0  # exp(-SPAN) is below double precision


def ema(df: DataFrame, spec: dict[str, str], alpha: float = 0.3, order: str = "frame_id") -> DataFrame:
    """Non-adjusted exponential moving averages ``{out: column}`` with the tabular null rule (w2, n7).

    A null row keeps the value and decays its weight, so an observation ``g`` rows after the last one gets
    ``alpha / ((1-alpha)**g + alpha)``; rows before the first observation are null.

    The recurrence is linear, ``y = p * y_before + q * x``, hence a running sum of ``q * x / P`` times ``P``, with ``P``
    the product of the ``p`` so far.  ``P`` leaves the range of doubles within some hundred rows, so its logarithm is cut
    into blocks of ``SPAN``: terms are scaled by where they lie in their block, summed within it, and the block before
    adds its whole sum.  Blocks further back weigh less than double precision.  A row costs a constant number of running
    sums, whatever its series' length.
    """
    keep = 1.0 - alpha
    w = player_window(order)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_row", F.row_number().over(w))
    out = out.withColumns({f"_at_{o}": F.last(F.when(F.col(c).isNotNull(), F.col("_row")), ignorenulls=True).over(before) for o, c in spec.items()})
    steps, shares = {}, {}
    for o, c in spec.items():
        gap = F.col("_row") - F.col(f"_at_{o}")
        total = F.pow(F.lit(keep), gap) + alpha
        follows = F.col(c).isNotNull() & F.col(f"_at_{o}").isNotNull()
        steps[f"_log_{o}"] = F.sum(F.when(follows, gap * -math.log(keep) + F.log(total)).otherwise(F.lit(0.0))).over(so_far)
        shares[f"_share_{o}"] = F.when(follows, alpha / total).when(F.col(c).isNotNull(), F.lit(1.0))
    out = out.withColumns(steps | shares)
    for o, c in spec.items():
        out = out.withColumn("_block", F.floor(F.col(f"_log_{o}") / SPAN))
        out = out.withColumn("_away", F.col(f"_log_{o}") - SPAN * F.col("_block"))
        out = out.withColumn("_term", F.col(f"_share_{o}") * F.col(c).cast("double") * F.exp("_away"))
        own = F.sum("_term").over(Window.partitionBy(*PLAYER, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_own", own)
        last = F.sum("_term").over(Window.partitionBy(*PLAYER).orderBy("_block").rangeBetween(-1, -1))
        out = out.withColumn("_last", F.coalesce(last, F.lit(0.0)) * math.exp(-SPAN))
        out = out.withColumn(o, (F.col("_own") + F.col("_last")) * F.exp(-F.col("_away")))
    return out.drop("_row", "_block", "_away", "_term", "_own", "_last", *[f"{n}{o}" for o in spec for n in ("_at_", "_log_", "_share_")])


def ema_features(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    spec = {"velocity_x_ema": "velocity_x", "velocity_y_ema": "velocity_y", "speed_ema": "s"}
    return ema(df, {k: v for k, v in spec.items() if v in df.columns}, alpha)


def rolling_mean(df: DataFrame, window_size: int = 8,
                 cols=("velocity_x", "velocity_y")) -> DataFrame:
    """Mean over the last ``window_size`` rows, nulls skipped, min one row (w3)."""
    frame = rows_back(window_size)
    return df.withColumns({f"{c}_roll": F.avg(c).over(frame) for c in cols if c in df.columns})


def lag_block(df: DataFrame, window_size: int = 8, alpha: float = 0.3) -> DataFrame:
    """Lags, EMAs and rolling means in one step, as the sequence pipeline uses them."""
    return rolling_mean(ema_features(lag_features(df), alpha), window_size)


def rolling_multi(df: DataFrame, windows=(3, 6, 9),
                  cols=("velocity_x", "velocity_y", "s", "a")) -> DataFrame:
    """Rolling mean and sample std (0 when fewer than two values) (w4, n5)."""
    out = {}
    for n in windows:
        frame = rows_back(n)
        for c in cols:
            if c in df.columns:
                out[f"{c}_roll{n}"] = F.avg(c).over(frame)
                out[f"{c}_std{n}"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
    return df.withColumns(out)


def unwrap_turn(c: F.Column) -> F.Column:
    """``x`` if |x| < 180 else ``x - 360*sign(x)`` (f23)."""
    return F.when(F.abs(c) < 180, c).otherwise(c - 360.0 * F.signum(c))


def diff_features(df: DataFrame) -> DataFrame:
    """First differences with 0 for the first row or a null side (w5, w6)."""
    w = player_window()
    out = df
    if "distance_to_ball" in df.columns:
        out = out.withColumn("distance_to_ball_change", diff_filled("distance_to_ball", w))
        out = out.withColumn("distance_to_ball_accel", diff_filled("distance_to_ball_change", w))
    if "velocity_x" in df.columns:
        out = out.withColumns({
            "velocity_x_change": diff_filled("velocity_x", w),
            "velocity_y_change": diff_filled("velocity_y", w),
            "speed_change": diff_filled("s", w),
            "direction_change": unwrap_turn(diff_filled("dir", w)),
        })
    return out


def jerk(df: DataFrame) -> DataFrame:
    """Difference of acceleration times 0.1 (w7; kept as defined: a product, not a rate)."""
    w = player_window()
    out = {}
    if "a" in df.columns:
        out["jerk"] = diff_filled("a", w) * 0.1
    if {"acceleration_x", "acceleration_y"} <= set(df.columns):
        out["jerk_x"] = diff_filled("acceleration_x", w) * 0.1
        out["jerk_y"] = diff_filled("acceleration_y", w) * 0.1
    return df.withColumns(out) if out else df


def curvature(df: DataFrame) -> DataFrame:
    """Bearing to the landing spot, lateral offset, curvature and its rolling means
    (f25, w8, w9)."""
    w = player_window()
    out = df
    if {"ball_land_x", "ball_land_y"} <= set(df.columns):
        dx = F.col("ball_land_x") - F.col("x")
        dy = F.col("ball_land_y") - F.col("y")
        heading = F.radians(F.coalesce(F.col("dir"), F.lit(0.0)))
        out = out.withColumns({"bearing_to_land_signed": turn_to(heading, dx, dy, at_rest=0.0), "land_lateral_offset": seen_from(heading, dx, dy)[1]})
    ddir = wrap_angle_deg(diff_filled("dir", w))
    denom = F.when(F.col("s") != 0, F.col("s")) * 0.1 + 1e-6
    out = out.withColumn("curvature_signed", F.coalesce(F.radians(ddir) / denom, F.lit(0.0)))
    out = out.withColumn("curvature_abs", F.abs(F.col("curvature_signed")))
    rolls = {}
    for n in (3, 5):
        frame = rows_back(n)
        rolls[f"curv_signed_roll{n}"] = F.avg("curvature_signed").over(frame)
        rolls[f"curv_abs_roll{n}"] = F.avg("curvature_abs").over(frame)
    return out.withColumns(rolls)


def elapsed(df: DataFrame) -> DataFrame:
    """0-based frame index and its share of the series (w10, w11)."""
    w = player_window()
    return df.withColumns({
        "frames_elapsed": (F.row_number().over(w) - 1).cast("bigint"),
        "normalized_time": (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*PLAYER)),
    })
