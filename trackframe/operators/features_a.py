"""Feature family A: per-row kinematic, field, angle and context features
(f1-f11, pr5, pr10, pr11, pr13, pr14).

Angle convention of this family: 0 degrees points along +x, so
``vx = s*cos(dir)`` and ``vy = s*sin(dir)``; bearings are in degrees.
Every function adds columns only when its inputs exist (checked on the
schema at plan time) and is a pure projection, so a chain of them collapses
into one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import flag, floor_mod, nan_greatest, nan_least

# Field width and centre line in yards, position groups.
FIELD_WIDTH = 53.3
FIELD_CENTRE_Y = 26.65
RECEIVER_POSITIONS = ["WR", "TE"]
DB_POSITIONS = ["CB", "SS", "FS", "DB", "S"]
LB_POSITIONS = ["LB", "ILB", "OLB", "MLB"]

# Model feature list of this family, in order.
FEATURES_A = [
    "x_input", "y_input", "s_input", "a_input", "dir_input", "o_input",
    "vx", "vy",
    "dist_to_ball_landing", "dist_from_los",
    "dist_to_near_sideline", "dist_from_center",
    "angle_to_ball", "pursuit_angle", "facing_ball", "body_alignment",
    "is_offense", "is_defense", "is_receiver", "is_db", "is_lb",
    "play_dir_right", "frame_progress",
    "ball_land_x", "ball_land_y",
    "frame_id", "num_frames_output",
]


def _pick(df: DataFrame, name: str) -> str | None:
    """``name_input`` when present, else ``name``, else None (pr14)."""
    for c in (f"{name}_input", name):
        if c in df.columns:
            return c
    return None


def wrapped_abs_diff(a, b):
    """|((a - b + 180) mod 360) - 180| with a floored modulo."""
    return F.abs(floor_mod(a - b + 180.0, 360.0) - 180.0)


def velocity(df: DataFrame) -> DataFrame:
    s, d = _pick(df, "s"), _pick(df, "dir")
    if s is None or d is None:
        return df
    rad = F.radians(F.col(d))
    return df.withColumns({"vx": F.col(s) * F.cos(rad), "vy": F.col(s) * F.sin(rad)})


def distance(df: DataFrame) -> DataFrame:
    x, y = _pick(df, "x"), _pick(df, "y")
    cols = {}
    if {"ball_land_x", "ball_land_y"} <= set(df.columns):
        cols["dist_to_ball_landing"] = F.sqrt(
            (F.col(x) - F.col("ball_land_x")) ** 2 + (F.col(y) - F.col("ball_land_y")) ** 2)
    if "absolute_yardline_number" in df.columns:
        cols["dist_from_los"] = F.col(x) - F.col("absolute_yardline_number")
    if y is not None:
        cols["dist_to_near_sideline"] = nan_least(F.col(y), FIELD_WIDTH - F.col(y))
        cols["dist_from_center"] = F.abs(F.col(y) - FIELD_CENTRE_Y)
    return df.withColumns(cols) if cols else df


def angle(df: DataFrame) -> DataFrame:
    x, y, d, o = (_pick(df, c) for c in ("x", "y", "dir", "o"))
    out = df
    if {"ball_land_x", "ball_land_y"} <= set(df.columns):
        out = out.withColumn("angle_to_ball", F.degrees(F.atan2(
            F.col("ball_land_y") - F.col(y), F.col("ball_land_x") - F.col(x))))
        if d is not None:
            out = out.withColumn("pursuit_angle", wrapped_abs_diff(F.col(d), F.col("angle_to_ball")))
            out = out.withColumn("facing_ball", flag(F.col("pursuit_angle") < 45))
    if d is not None and o is not None:
        out = out.withColumn("body_alignment", wrapped_abs_diff(F.col(o), F.col(d)))
    return out


def player_context(df: DataFrame) -> DataFrame:
    cols = {}
    if "player_side" in df.columns:
        cols["is_offense"] = flag(F.col("player_side") == "Offense")
        cols["is_defense"] = flag(F.col("player_side") == "Defense")
    if "player_position" in df.columns:
        pos = F.col("player_position")
        cols["is_receiver"] = flag(pos.isin(RECEIVER_POSITIONS))
        cols["is_db"] = flag(pos.isin(DB_POSITIONS))
        cols["is_lb"] = flag(pos.isin(LB_POSITIONS))
    if "play_direction" in df.columns:
        cols["play_dir_right"] = flag(F.col("play_direction") == "right")
    if {"frame_id", "num_frames_output"} <= set(df.columns):
        cols["frame_progress"] = F.col("frame_id") / nan_greatest(
            F.col("num_frames_output").cast("double"), F.lit(1.0))
    return df.withColumns(cols) if cols else df


def target_relative(df: DataFrame) -> DataFrame:
    """Displacement from the last input position to the target (training only)."""
    x, y = _pick(df, "x"), _pick(df, "y")
    if not ({"x", "y"} <= set(df.columns)):
        return df
    dx = F.col("x") - F.col(x)
    dy = F.col("y") - F.col(y)
    return df.withColumns({
        "target_displacement_x": dx,
        "target_displacement_y": dy,
        "target_displacement_dist": F.sqrt(dx ** 2 + dy ** 2),
    })


def engineer(df: DataFrame, is_training: bool = True, use_velocity: bool = True,
             use_distance: bool = True, use_angle: bool = True) -> DataFrame:
    """Family A in order, with the three honoured group toggles (pr13)."""
    if use_velocity:
        df = velocity(df)
    if use_distance:
        df = distance(df)
    if use_angle:
        df = angle(df)
    df = player_context(df)
    if is_training:
        df = target_relative(df)
    return df


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The wanted names that exist, in wanted order, first occurrence only (pr5, pr6)."""
    seen: list[str] = []
    for n in names:
        if n in df.columns and n not in seen:
            seen.append(n)
    return seen
