"""Play-direction normalisation (f24, f26, f27, a3, j4, j5, v9).

Rightward plays are mirrored so every play runs left; predictions are mapped
back afterwards.  The direction map has one row per play, so it grows with the
data: it is joined on the play key (co-partitioned with the tracking rows, no
exchange), never broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import floor_mod
from trackframe.sources.tracking import PLAY

# Field length and width in yards.
FIELD_LENGTH = 120.0
FIELD_WIDTH = 53.3


def wrap_angle_deg(c) -> F.Column:
    """Map degrees to [-180, 180) with a floored modulo (f24)."""
    c = F.col(c) if isinstance(c, str) else c
    return floor_mod(c + 180.0, 360.0) - 180.0


def is_right() -> F.Column:
    return F.coalesce(F.col("play_direction") == "right", F.lit(False))


def unify_left(df: DataFrame) -> DataFrame:
    """Mirror rightward plays: x -> 120-x, y -> 53.3-y, dir/o -> (+180) mod 360,
    ball landing mirrored too; only the columns present are touched (f26)."""
    if "play_direction" not in df.columns:
        return df
    right = is_right()
    cols = {}
    for c, length in (("x", FIELD_LENGTH), ("y", FIELD_WIDTH),
                      ("ball_land_x", FIELD_LENGTH), ("ball_land_y", FIELD_WIDTH)):
        if c in df.columns:
            cols[c] = F.when(right, length - F.col(c)).otherwise(F.col(c))
    for c in ("dir", "o"):
        if c in df.columns:
            cols[c] = F.when(right, floor_mod(F.col(c) + 180.0, 360.0)).otherwise(F.col(c))
    return df.withColumns(cols) if cols else df


def invert_to_original(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Map unified coordinates back to the play's own direction (f27)."""
    right = is_right()
    return df.withColumns({
        x: F.when(right, FIELD_LENGTH - F.col(x)).otherwise(F.col(x)),
        y: F.when(right, FIELD_WIDTH - F.col(y)).otherwise(F.col(y)),
    })


def direction_map(df: DataFrame) -> DataFrame:
    """Distinct (game_id, play_id, play_direction) (a3)."""
    return df.select(*PLAY, "play_direction").distinct()


def apply_direction(df: DataFrame, dir_map: DataFrame) -> DataFrame:
    """Attach the play direction when missing, then unify (j4).  Rows never multiply: a play with two directions
    fails the query (``direction_violations`` counts such plays beforehand)."""
    if "play_direction" not in df.columns:
        several = F.raise_error(F.concat(F.lit("two directions in play "), F.concat_ws("/", *PLAY)))
        one = dir_map.groupBy(*PLAY).agg(F.min("play_direction").alias("lo"), F.max("play_direction").alias("hi"))
        one = one.select(*PLAY, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), several.cast("string")).alias("play_direction"))
        df = df.join(one, PLAY, "left")
    return unify_left(df)


def direction_violations(dir_map: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Plays with more than one direction, and rows left without one (j5, v9).

    One row per check: (check, violations).  Both are aggregates on the play
    key, so the check runs distributed and returns two rows.
    """
    multi = (dir_map.groupBy(*PLAY).agg(F.count_distinct("play_direction").alias("k"))
             .agg(F.count_if(F.col("k") > 1).alias("violations"))
             .select(F.lit("direction_not_unique").alias("check"), "violations"))
    if rows is None:
        return multi
    missing = rows.agg(F.count_if(F.col("play_direction").isNull()).alias("violations")).select(
        F.lit("direction_missing").alias("check"), "violations")
    return multi.unionByName(missing)
