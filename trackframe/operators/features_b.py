"""Feature family B: base kinematics, roles, physics, ball vector and the
derived 'advanced' features (f12-f23), plus the family's feature list (pr6).

Angle convention of this family: 0 degrees points along +y, so
``velocity_x = (s + 0.5 a dt) * sin(dir)``; ``angle_to_ball`` is in radians.
Columns are added only when their inputs exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import clip, flag, nan_greatest, nan_least
from trackframe.operators import temporal

# Frame length (s), pounds per kg, default weight (lb) and
# height (ft), field size (yd).
DELTA_T = 0.1
LB_PER_KG = 2.20462
DEFAULT_WEIGHT_LB = 200.0
DEFAULT_HEIGHT_FT = 6.0
FIELD_LENGTH = 120.0
FIELD_WIDTH = 53.3

# Model feature list of this family, in order.  The ball and the
# opponent closing speeds carry distinct names here (ball_closing_speed,
# opp_closing_speed) instead of sharing one.
FEATURES_B = [
    "x", "y", "s", "a", "o", "dir", "frame_id",
    "ball_land_x", "ball_land_y",
    "player_height_feet", "player_weight",
    "velocity_x", "velocity_y", "acceleration_x", "acceleration_y",
    "momentum_x", "momentum_y", "kinetic_energy",
    "is_offense", "is_defense", "is_receiver", "is_coverage", "is_passer",
    "distance_to_ball", "angle_to_ball", "ball_direction_x", "ball_direction_y", "ball_closing_speed",
    "x_lag1", "y_lag1", "velocity_x_lag1", "velocity_y_lag1",
    "x_lag2", "y_lag2", "velocity_x_lag2", "velocity_y_lag2",
    "x_lag3", "y_lag3", "velocity_x_lag3", "velocity_y_lag3",
    "x_lag4", "y_lag4", "velocity_x_lag4", "velocity_y_lag4",
    "x_lag5", "y_lag5", "velocity_x_lag5", "velocity_y_lag5",
    "velocity_x_ema", "velocity_y_ema", "speed_ema",
    "velocity_x_roll", "velocity_y_roll",
    "distance_to_ball_change", "distance_to_ball_accel", "time_to_intercept",
    "velocity_alignment", "velocity_perpendicular", "accel_alignment",
    "velocity_x_change", "velocity_y_change", "speed_change", "direction_change",
    "dist_from_sideline", "dist_from_endzone",
    "receiver_optimality", "receiver_deviation", "defender_closing_speed",
    "frames_elapsed", "normalized_time", "velocity_x_delta", "velocity_y_delta",
    "nearest_opp_dist", "opp_closing_speed", "num_nearby_opp_3", "num_nearby_opp_5",
    "mirror_wr_vx", "mirror_wr_vy", "mirror_offset_x", "mirror_offset_y", "mirror_wr_dist",
    "pressure", "under_pressure", "pressure_x_speed",
    "mirror_similarity", "mirror_offset_dist", "mirror_alignment",
]


def height_feet(c: str = "player_height") -> F.Column:
    """``ft-in`` to feet; anything but exactly two integer parts gives 6.0 (f12)."""
    parts = F.split(F.col(c), "-")
    ft = F.try_element_at(parts, F.lit(1)).try_cast("int")
    inch = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ok = (F.size(parts) == 2) & ft.isNotNull() & inch.isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), ft + inch / 12.0).otherwise(F.lit(DEFAULT_HEIGHT_FT))


def base_features(df: DataFrame) -> DataFrame:
    """Height, velocity and acceleration components, roles, mass terms, ball vector (f12-f15)."""
    rad = F.radians(F.coalesce(F.col("dir"), F.lit(0.0)))
    speed = F.col("s") + 0.5 * F.col("a") * DELTA_T
    out = df.withColumns({
        "player_height_feet": height_feet(),
        "velocity_x": speed * F.sin(rad),
        "velocity_y": speed * F.cos(rad),
        "acceleration_x": F.col("a") * F.sin(rad),
        "acceleration_y": F.col("a") * F.cos(rad),
        "is_offense": flag(F.col("player_side") == "Offense"),
        "is_defense": flag(F.col("player_side") == "Defense"),
        "is_receiver": flag(F.col("player_role") == "Targeted Receiver"),
        "is_coverage": flag(F.col("player_role") == "Defensive Coverage"),
        "is_passer": flag(F.col("player_role") == "Passer"),
    })
    mass = F.coalesce(F.col("player_weight"), F.lit(DEFAULT_WEIGHT_LB)) / LB_PER_KG
    out = out.withColumns({
        "momentum_x": F.col("velocity_x") * mass,
        "momentum_y": F.col("velocity_y") * mass,
        "kinetic_energy": 0.5 * mass * F.col("s") ** 2,
    })
    if "ball_land_x" in df.columns:
        bdx = F.col("ball_land_x") - F.col("x")
        bdy = F.col("ball_land_y") - F.col("y")
        out = out.withColumns({
            "distance_to_ball": F.sqrt(bdx ** 2 + bdy ** 2),
            "angle_to_ball": F.atan2(bdy, bdx),
        })
        out = out.withColumns({
            "ball_direction_x": bdx / (F.col("distance_to_ball") + 1e-6),
            "ball_direction_y": bdy / (F.col("distance_to_ball") + 1e-6),
        })
        out = out.withColumn("ball_closing_speed",
                             F.col("velocity_x") * F.col("ball_direction_x")
                             + F.col("velocity_y") * F.col("ball_direction_y"))
    return out


def advanced_features(df: DataFrame) -> DataFrame:
    """Ball-relative, field, role, time, physics, pressure and mirror features (f16-f22, w5, w6, w10, w11)."""
    cols = set(df.columns)
    out = temporal.diff_features(df)
    if "distance_to_ball" in cols:
        out = out.withColumn("time_to_intercept", clip(
            F.col("distance_to_ball") / (F.abs(F.col("distance_to_ball_change")) + 0.1), 0.0, 10.0))
    if "ball_direction_x" in cols:
        bx, by = F.col("ball_direction_x"), F.col("ball_direction_y")
        out = out.withColumns({
            "velocity_alignment": F.col("velocity_x") * bx + F.col("velocity_y") * by,
            "velocity_perpendicular": F.col("velocity_x") * (-by) + F.col("velocity_y") * bx,
        })
        if "acceleration_x" in cols:
            out = out.withColumn("accel_alignment",
                                 F.col("acceleration_x") * bx + F.col("acceleration_y") * by)
    out = out.withColumns({
        "dist_from_left": F.col("y"),
        "dist_from_right": FIELD_WIDTH - F.col("y"),
        "dist_from_sideline": nan_least(F.col("y"), FIELD_WIDTH - F.col("y")),
        "dist_from_endzone": nan_least(F.col("x"), FIELD_LENGTH - F.col("x")),
    })
    if "is_receiver" in cols and "velocity_alignment" in out.columns:
        out = out.withColumns({
            "receiver_optimality": F.col("is_receiver") * F.col("velocity_alignment"),
            "receiver_deviation": F.col("is_receiver") * F.abs(F.col("velocity_perpendicular")),
        })
    if "is_coverage" in cols and "ball_closing_speed" in cols:
        out = out.withColumn("defender_closing_speed", F.col("is_coverage") * F.col("ball_closing_speed"))
    out = temporal.elapsed(out)
    turn = F.abs(F.col("o") - F.col("dir"))
    out = out.withColumns({
        "speed_squared": F.col("s") ** 2,
        "accel_magnitude": F.sqrt(F.col("acceleration_x") ** 2 + F.col("acceleration_y") ** 2),
        "orientation_diff": nan_least(turn, 360.0 - turn),
    })
    if "nearest_opp_dist" in cols:
        pressure = 1.0 / nan_greatest(F.col("nearest_opp_dist"), F.lit(0.5))
        out = out.withColumns({
            "pressure": pressure,
            "under_pressure": flag(F.col("nearest_opp_dist") < 3),
            "pressure_x_speed": pressure * F.col("s"),
        })
    if "mirror_wr_vx" in cols:
        s_safe = nan_greatest(F.col("s"), F.lit(0.1))
        sim = (F.col("velocity_x") * F.col("mirror_wr_vx")
               + F.col("velocity_y") * F.col("mirror_wr_vy")) / s_safe
        out = out.withColumns({
            "mirror_similarity": sim,
            "mirror_offset_dist": F.sqrt(F.col("mirror_offset_x") ** 2 + F.col("mirror_offset_y") ** 2),
            "mirror_alignment": sim * F.col("is_coverage"),
        })
    return out
