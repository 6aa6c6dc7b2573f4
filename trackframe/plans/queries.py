"""Registered queries: one per operator family, each (spark, sf_dir) -> DataFrame.

Every query starts from the tables in ``sf_dir`` (the tracking fixture derived
from ``events``), so its work grows with the data.  Computed doubles are
rounded to 6 places so the result can be compared value-for-value with the
SQL oracle in ``trackframe.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions.batches import pad_histories
from trackframe.functions.nulls import clip
from trackframe.operators import (boosting, direction, features_a, features_b, folds, interactions, metrics, predict,
                                  modeling, profile, quality, scaling, sequences, state, temporal)
from trackframe.session import cut_lineage, ensure_checkpoint_dir
from trackframe.sources import files
from trackframe.sources import tracking as trk
from trackframe.streaming import plays, scoring

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def round6(c) -> F.Column:
    """Round half away from zero on the double itself: round(x * 1e6) / 1e6.

    The oracle engine rounds this way; ``F.round`` rounds the shortest decimal
    text instead, and the two disagree on exact decimal ties.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


def round9(c: str) -> F.Column:
    return F.signum(c) * F.floor(F.abs(c) * 1e9 + 0.5) / 1e9


def r6(df: DataFrame, cols: list[str]) -> DataFrame:
    """Moving averages are settled to 9 places first: those of short decimals hit ties of the sixth place, which the
    running sums here and the oracle's recursion may approach from either side."""
    settled = {c: round9(c) for c in cols if c.endswith("_ema")}
    return df.withColumns(settled).withColumns({c: round6(c) for c in cols})


def _tables(spark: SparkSession, sf_dir: str):
    return trk.tracking_tables(spark, sf_dir)


def _samples(spark, sf_dir):
    """Target rows with the last input state (window form: one scan, one exchange)."""
    return state.fused_training_samples(trk.tracking_from_events(spark, sf_dir))


def _scoring(spark, sf_dir):
    """Every post-pass row keyed by id, with the last input state."""
    s = state.attach_input_state(trk.tracking_from_events(spark, sf_dir))
    return s.drop("x", "y", "week").withColumn("id", trk.row_id())


def _truth(spark, sf_dir):
    _, out = _tables(spark, sf_dir)
    return out.select(*trk.PLAY, trk.row_id().alias("id"), "x", "y")


# ------------------------------------------------------------------ slice
@register("last_state")
def q_last_state(spark, sf_dir):
    inp, _ = _tables(spark, sf_dir)
    return state.last_state(inp)


@register("training_samples")
def q_training_samples(spark, sf_dir):
    return _samples(spark, sf_dir)


FEATA_DOUBLES = [
    "x_input", "y_input", "s_input", "a_input", "dir_input", "o_input", "vx", "vy",
    "dist_to_ball_landing", "dist_from_los", "dist_to_near_sideline", "dist_from_center",
    "angle_to_ball", "pursuit_angle", "body_alignment", "frame_progress",
    "target_displacement_x", "target_displacement_y", "target_displacement_dist",
]


@register("features_a")
def q_features_a(spark, sf_dir):
    df = features_a.engineer(_samples(spark, sf_dir), is_training=True)
    cols = ["id", "game_id", "play_id", "nfl_id", "frame_id"] + FEATA_DOUBLES + [
        "facing_ball", "is_offense", "is_defense", "is_receiver", "is_db", "is_lb",
        "play_dir_right", "ball_land_x", "ball_land_y", "num_frames_output"]
    return r6(df.select(*cols), FEATA_DOUBLES)


@register("physics_baseline")
def q_physics_baseline(spark, sf_dir):
    pred = predict.physics_baseline(_scoring(spark, sf_dir))
    return r6(pred.select("id", "game_id", "play_id", "x", "y", "fallback"), ["x", "y"])


@register("rmse_score")
def q_rmse_score(spark, sf_dir):
    pred = predict.physics_baseline(_scoring(spark, sf_dir))
    rep = metrics.rmse_report(_truth(spark, sf_dir), pred)
    return r6(rep, ["rmse", "rmse_x", "rmse_y"])


# ------------------------------------------------------ family B, windows
def _input(spark, sf_dir):
    return _tables(spark, sf_dir)[0]


def _base(spark, sf_dir):
    """Direction-unified input frames with the base features of family B."""
    return features_b.base_features(direction.unify_left(_input(spark, sf_dir)))


FRAME_KEY = ["game_id", "play_id", "nfl_id", "frame_id"]


def _keyed(df, cols):
    return r6(df.select(*FRAME_KEY, *cols), cols)


@register("direction_unify")
def q_direction_unify(spark, sf_dir):
    u = direction.unify_left(_input(spark, sf_dir))
    return _keyed(u, ["x", "y", "dir", "o", "ball_land_x", "ball_land_y"])


@register("direction_roundtrip")
def q_direction_roundtrip(spark, sf_dir):
    inp, out = _tables(spark, sf_dir)
    dmap = direction.direction_map(inp)
    u = direction.apply_direction(out.drop("week"), dmap)
    u = u.withColumns({"x_u": F.col("x"), "y_u": F.col("y")})
    back = direction.invert_to_original(u)
    return r6(back.select(*FRAME_KEY, "play_direction", "x_u", "y_u", "x", "y"), ["x_u", "y_u", "x", "y"])


BASE_B = ["player_height_feet", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y",
          "momentum_x", "momentum_y", "kinetic_energy", "distance_to_ball", "angle_to_ball",
          "ball_direction_x", "ball_direction_y", "ball_closing_speed"]
FLAGS_B = ["is_offense", "is_defense", "is_receiver", "is_coverage", "is_passer"]


@register("features_b_base")
def q_features_b_base(spark, sf_dir):
    b = _base(spark, sf_dir)
    return r6(b.select(*FRAME_KEY, *BASE_B, *FLAGS_B), BASE_B)


@register("height_parse")
def q_height_parse(spark, sf_dir):
    inp = _input(spark, sf_dir)
    return (inp.select(*trk.PLAYER, "player_height",
                       features_b.height_feet().alias("player_height_feet"))
            .distinct().transform(lambda d: r6(d, ["player_height_feet"])))


LAGS = [f"{c}_lag{k}" for k in range(1, 6) for c in ("x", "y", "velocity_x", "velocity_y")]


@register("lag_features")
def q_lag_features(spark, sf_dir):
    return _keyed(temporal.lag_features(_base(spark, sf_dir)), LAGS)


@register("ema_features")
def q_ema_features(spark, sf_dir):
    return _keyed(temporal.ema_features(_base(spark, sf_dir)),
                  ["velocity_x_ema", "velocity_y_ema", "speed_ema"])


@register("rolling_mean")
def q_rolling_mean(spark, sf_dir):
    return _keyed(temporal.rolling_mean(_base(spark, sf_dir), window_size=12),
                  ["velocity_x_roll", "velocity_y_roll"])


MULTI = [f"{c}_{k}{n}" for n in (3, 6, 9) for c in ("velocity_x", "velocity_y", "s", "a")
         for k in ("roll", "std")]


@register("rolling_multi")
def q_rolling_multi(spark, sf_dir):
    return _keyed(temporal.rolling_multi(_base(spark, sf_dir)), MULTI)


DIFFS = ["distance_to_ball_change", "distance_to_ball_accel", "velocity_x_change",
         "velocity_y_change", "speed_change", "direction_change"]


@register("diff_features")
def q_diff_features(spark, sf_dir):
    return _keyed(temporal.diff_features(_base(spark, sf_dir)), DIFFS)


ADVANCED = ["time_to_intercept", "velocity_alignment", "velocity_perpendicular", "accel_alignment",
            "dist_from_left", "dist_from_right", "dist_from_sideline", "dist_from_endzone",
            "receiver_optimality", "receiver_deviation", "defender_closing_speed",
            "normalized_time", "speed_squared", "accel_magnitude", "orientation_diff"]


@register("advanced_features")
def q_advanced_features(spark, sf_dir):
    adv = features_b.advanced_features(_base(spark, sf_dir))
    return r6(adv.select(*FRAME_KEY, *ADVANCED, "frames_elapsed"), ADVANCED)


@register("jerk")
def q_jerk(spark, sf_dir):
    return _keyed(temporal.jerk(_base(spark, sf_dir)), ["jerk", "jerk_x", "jerk_y"])


CURV = ["bearing_to_land_signed", "land_lateral_offset", "curvature_signed", "curvature_abs",
        "curv_signed_roll3", "curv_abs_roll3", "curv_signed_roll5", "curv_abs_roll5"]


@register("curvature")
def q_curvature(spark, sf_dir):
    return _keyed(temporal.curvature(_base(spark, sf_dir)), CURV)


@register("elapsed_time")
def q_elapsed_time(spark, sf_dir):
    e = temporal.elapsed(_input(spark, sf_dir))
    return r6(e.select(*FRAME_KEY, "frames_elapsed", "normalized_time"), ["normalized_time"])


# ------------------------------------------------------------ interactions
OPP = ["nearest_opp_dist", "opp_closing_speed"]
MIRROR = ["mirror_wr_vx", "mirror_wr_vy", "mirror_offset_x", "mirror_offset_y", "mirror_wr_dist"]
QB = ["qb_distance", "vel_to_qb_alignment", "vel_to_qb_perp", "bearing_to_qb_signed",
      "bearing_to_qb_sin", "bearing_to_qb_cos"]


@register("nearest_opponent")
def q_nearest_opponent(spark, sf_dir):
    opp = interactions.opponent_features(_base(spark, sf_dir))
    return r6(opp.select(*trk.PLAYER, *OPP, "num_nearby_opp_3", "num_nearby_opp_5"), OPP)


@register("mirror_receiver")
def q_mirror_receiver(spark, sf_dir):
    opp = interactions.opponent_features(_base(spark, sf_dir))
    return r6(opp.select(*trk.PLAYER, *MIRROR), MIRROR)


@register("qb_relative")
def q_qb_relative(spark, sf_dir):
    return _keyed(interactions.qb_relative(_base(spark, sf_dir)), QB)


@register("radius_graph")
def q_radius_graph(spark, sf_dir):
    g = interactions.radius_graph(_samples(spark, sf_dir))
    return r6(g, ["dist", "weight"])


NBR_FEATURES = ["x_input", "y_input", "s_input", "vx", "vy"]


@register("neighbour_mean")
def q_neighbour_mean(spark, sf_dir):
    nodes = features_a.velocity(_samples(spark, sf_dir))
    nm = interactions.neighbour_mean(nodes, NBR_FEATURES)
    cols = [f"nbr_{f}" for f in NBR_FEATURES]
    return r6(nm.select(*trk.FRAME, "nfl_id", *cols), cols)


HOPS = 3


@register("message_passing")
def q_message_passing(spark, sf_dir):
    """Three hops of message passing over each frame's radius graph (j15)."""
    nodes = features_a.velocity(_samples(spark, sf_dir))
    got = interactions.propagate(nodes, NBR_FEATURES, HOPS)
    cols = [f"hop{k}_{f}" for k in range(1, HOPS + 1) for f in NBR_FEATURES]
    return r6(got.select(*trk.FRAME, "nfl_id", *cols), cols)


@register("graph_nodes")
def q_graph_nodes(spark, sf_dir):
    """The node table of each frame (q6), its feature array spread over columns."""
    nodes = sequences.graph_nodes(features_a.velocity(_samples(spark, sf_dir)), NBR_FEATURES)
    parts = [F.col("features")[i].alias(f"f_{c}") for i, c in enumerate(NBR_FEATURES)]
    return r6(nodes.select(*trk.FRAME, "nfl_id", F.size("features").alias("width"), *parts, "x", "y"), [f"f_{c}" for c in NBR_FEATURES])


@register("single_step")
def q_single_step(spark, sf_dir):
    """Samples as sequences of one step (q7), nulls as zeros, spread over columns."""
    one = sequences.single_step(features_a.velocity(_samples(spark, sf_dir)), NBR_FEATURES)
    parts = [F.col("sequence")[0]["features"][i].alias(f"f_{c}") for i, c in enumerate(NBR_FEATURES)]
    return r6(one.select("id", F.size("sequence").alias("steps"), *parts), [f"f_{c}" for c in NBR_FEATURES])


# ------------------------------------------------------------ sequences
def _feat_b(spark, sf_dir):
    return sequences.feature_pipeline_b(_input(spark, sf_dir))


@register("tail_window")
def q_tail_window(spark, sf_dir):
    t = sequences.tail_window(_input(spark, sf_dir))
    return t.select(*trk.PLAYER, "step", "frame_id", "group_rows")


@register("sequence_train")
def q_sequence_train(spark, sf_dir):
    inp, _ = _tables(spark, sf_dir)
    feat = sequences.feature_pipeline_b(inp)
    cols = sequences.feature_columns_b(feat)
    # the input rows carry their player's number of output frames: no join finds out which players have any
    w = sequences.training_windows(feat.where("num_frames_output > 0"), None, cols)
    return r6(w, cols)


@register("sequence_arrays")
def q_sequence_arrays(spark, sf_dir):
    """Training windows in array form (q2): by player the number of steps, and some features' dot product with the steps."""
    inp, _ = _tables(spark, sf_dir)
    feat = sequences.feature_pipeline_b(inp)
    cols = sequences.feature_columns_b(feat)
    arrays = sequences.to_arrays(sequences.training_windows(feat.where("num_frames_output > 0"), None, cols), cols)

    def dot(c: str) -> F.Column:
        return F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + (s["step"] + 1) * s["features"][cols.index(c)])
    names = ["x", "y", "s", "distance_to_ball", "nearest_opp_dist"]
    out = arrays.select(*trk.PLAYER, F.size("sequence").cast("bigint").alias("steps"), *[dot(c).alias(f"dot_{c}") for c in names])
    return r6(out, [f"dot_{c}" for c in names])


@register("sequence_score")
def q_sequence_score(spark, sf_dir):
    inp, _ = _tables(spark, sf_dir)
    feat = sequences.feature_pipeline_b(inp)
    cols = sequences.feature_columns_b(feat)
    w = sequences.scoring_windows(feat.where("num_frames_output > 0"), None, cols)
    return r6(w, cols)


@register("target_deltas")
def q_target_deltas(spark, sf_dir):
    inp, out = _tables(spark, sf_dir)
    feat = sequences.feature_pipeline_b(inp)
    cols = sequences.feature_columns_b(feat)
    # windows for every player with input: the inner join to the output rows
    # selects the targets, so the output table is read once
    w = sequences.training_windows(feat, None, cols)
    return r6(sequences.target_deltas(out, w), ["dx", "dy"])


HIST_FEATURES = ["x_input", "y_input", "s_input", "a_input", "dir_input", "o_input", "vx", "vy",
                 "dist_from_los", "frame_progress"]
PADDED_ROWS = 512  # histories that a Python worker pads at once


@register("history_sequence")
def q_history_sequence(spark, sf_dir):
    inp, _ = _tables(spark, sf_dir)
    samples = features_a.engineer(_samples(spark, sf_dir), is_training=False)
    hist = features_a.engineer(inp, is_training=False).withColumnsRenamed(
        {c: f"{c}_input" for c in ("x", "y", "s", "a", "dir", "o")})
    seq = sequences.history_sequences(hist, samples, HIST_FEATURES)
    return r6(seq, HIST_FEATURES)


@register("history_arrays")
def q_history_arrays(spark, sf_dir):
    """Histories as arrays (q5), padded where a model would read them: by sample the number of steps, and each feature's
    dot product with the places 1 to 100."""
    t = state.attach_input_state(trk.tracking_from_events(spark, sf_dir), keep_input=True)
    rows = features_a.engineer(t.withColumn("id", trk.row_id()), is_training=False).where("is_out = 0 or player_to_predict")
    arrays = sequences.history_arrays(rows, HIST_FEATURES)
    names = [f"dot_{c}" for c in HIST_FEATURES]
    at_once = PADDED_ROWS

    def dots(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            got = [np.zeros((0, len(names)))]
            for k in range(0, b.num_rows, at_once):
                some = b.slice(k, at_once).to_pandas()
                padded = pad_histories(some["history"].tolist(), some["query"].tolist())
                got.append(np.einsum("rsf,s->rf", padded, np.arange(1.0, padded.shape[1] + 1)))
            sums = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hist_len").cast(pa.int64()), *[pa.array(sums[:, k]) for k in range(len(names))]], ["id", "hist_len", *names])
    return r6(arrays.mapInArrow(dots, "id string, hist_len bigint, " + ", ".join(f"{n} double" for n in names)), names)


@register("trajectory_cumsum")
def q_trajectory_cumsum(spark, sf_dir):
    """Per-step displacements of the post-pass path, summed back into offsets
    from the last input position."""
    s = state.attach_input_state(trk.tracking_from_events(spark, sf_dir))
    w = Window.partitionBy(*trk.PLAYER).orderBy("frame_id")
    steps = s.select(*trk.PLAYER, "frame_id",
                     (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x_input"))).alias("ddx"),
                     (F.col("y") - F.coalesce(F.lag("y").over(w), F.col("y_input"))).alias("ddy"))
    c = sequences.cumulative(steps, ["ddx", "ddy"], order="frame_id")
    return r6(c.select(*trk.PLAYER, "frame_id", "cum_ddx", "cum_ddy"), ["cum_ddx", "cum_ddy"])


@register("horizon_hold")
def q_horizon_hold(spark, sf_dir):
    """Constant-velocity sequence model end to end: scoring windows give the
    anchor and velocity, per-step deltas over the horizon are summed, each
    requested frame takes its held step, and positions are mapped back."""
    inp, out = _tables(spark, sf_dir)
    base = features_b.base_features(direction.unify_left(inp))
    cols = ["x", "y", "velocity_x", "velocity_y"]
    requests = out.select(*trk.PLAYER, "frame_id", trk.row_id().alias("id"))
    # windows for every player with input; the keyed join to the requests
    # selects; each step row carries its anchor, so the windows are read once
    w = sequences.scoring_windows(base, None, cols)
    last = w.where(F.col("step") == sequences.WINDOW_SIZE - 1)
    per_step = last.select(*trk.PLAYER, "play_direction", F.col("x").alias("last_x"), F.col("y").alias("last_y"),
                           F.explode(F.sequence(F.lit(0), F.lit(sequences.MAX_HORIZON - 1))).alias("step"),
                           (F.col("velocity_x") * 0.1).alias("sdx"), (F.col("velocity_y") * 0.1).alias("sdy"))
    steps = sequences.cumulative(per_step, ["sdx", "sdy"]).select(
        *trk.PLAYER, "step", "play_direction", "last_x", "last_y",
        F.col("cum_sdx").alias("dx"), F.col("cum_sdy").alias("dy"))
    rec = sequences.reconstruct(requests, steps)
    return r6(rec.select("id", *trk.PLAY, "nfl_id", "frame_id", "step", "x", "y"), ["x", "y"])


# ------------------------------------------ quality, profile, scaling, models
@register("numeric_coerce")
def q_numeric_coerce(spark, sf_dir):
    inp = _input(spark, sf_dir)
    cols = ["player_height", "player_weight", "dir", "o"]
    return scaling.coerce_numeric(inp.select(*FRAME_KEY, *cols), cols)


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    df = features_a.engineer(_samples(spark, sf_dir), is_training=False)
    cols = features_a.present(df, features_a.FEATURES_A)
    df = cut_lineage(scaling.finite_features(df.select("id", *cols), cols))  # read for the statistics and for the result
    scaled = scaling.apply_scaler(df, scaling.fit_scaler(df, cols), cols)
    return r6(scaled, cols)


@register("play_split")
def q_play_split(spark, sf_dir):
    return modeling.split_by_play(profile.plays_with_targets(trk.plain_frames(spark, sf_dir)))


def _members():
    """Members of the blend as columns of the scoring rows; the physics one is null where a state value is missing."""
    rad, dt = F.radians(F.col("dir_input")), predict.FRAME_SECONDS * F.col("frame_id")
    phys = (clip(F.col("x_input") + F.col("s_input") * F.cos(rad) * dt, 0.0, predict.FIELD_LENGTH),
            clip(F.col("y_input") + F.col("s_input") * F.sin(rad) * dt, 0.0, predict.FIELD_WIDTH))
    return {"physics": phys, "stationary": (F.col("x_input"), F.col("y_input")),
            "centre": (F.lit(predict.CENTRE_X), F.lit(predict.CENTRE_Y))}


BLEND_WEIGHTS = {"physics": 0.3, "stationary": 0.4, "centre": 0.3}


@register("blend")
def q_blend(spark, sf_dir):
    x, y = predict.blend_columns(_members(), BLEND_WEIGHTS)
    return r6(_scoring(spark, sf_dir).select("id", x.alias("x"), y.alias("y")), ["x", "y"])


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """RMSE of the closed-form predictors and their blend on the held-out plays (f28-f30, m6, a10), in one aggregate."""
    rows = state.attach_input_state(trk.tracking_from_events(spark, sf_dir))
    held = modeling.split_by_play(rows).where("is_val")
    members = _members()
    px, py = predict.physics_columns(held)
    models = {"zero": (F.lit(0.0), F.lit(0.0)), "stationary": members["stationary"],
              "physics": (clip(px, 0.0, predict.FIELD_LENGTH), clip(py, 0.0, predict.FIELD_WIDTH)),
              "blend": predict.blend_columns(members, BLEND_WEIGHTS)}
    return r6(metrics.compare_models(held, models), ["rmse", "rmse_x", "rmse_y"])


@register("fold_mean")
def q_fold_mean(spark, sf_dir):
    fm = modeling.fold_mean_model(_samples(spark, sf_dir), _scoring(spark, sf_dir))
    return r6(fm, ["x", "y"])


FOLDS = 5


@register("fold_scalers")
def q_fold_scalers(spark, sf_dir):
    """The scaler of each fold's member, all from one pass (m5, a13, a14)."""
    df = modeling.fold_of_play(features_a.engineer(_samples(spark, sf_dir), is_training=False), FOLDS)
    cols = features_a.present(df, features_a.FEATURES_A)
    fitted = folds.members(folds.fold_moments(df, cols, ["x", "y"]), len(cols), FOLDS)
    return r6(folds.scalers(spark, fitted, cols), ["mean", "scale"])


RIDGE = ["reach_x", "reach_y"]


def _reach(df):
    """The way that the last velocity covers up to the row's frame."""
    dt, rad = predict.FRAME_SECONDS * F.col("frame_id"), F.radians(F.col("dir_input"))
    return df.withColumns({"reach_x": F.col("s_input") * F.cos(rad) * dt, "reach_y": F.col("s_input") * F.sin(rad) * dt})


def _ridge(spark, sf_dir):
    s = modeling.fold_of_play(_reach(_samples(spark, sf_dir)), FOLDS)
    s = s.withColumns({"dx": F.col("x") - F.col("x_input"), "dy": F.col("y") - F.col("y_input")})
    return s, folds.members(folds.fold_moments(s, RIDGE, ["dx", "dy"]), len(RIDGE), FOLDS)


@register("fold_ridge")
def q_fold_ridge(spark, sf_dir):
    """The mean of the folds' ridge members, each with its own scaler, for every request (m5)."""
    _, fitted = _ridge(spark, sf_dir)
    dx, dy = folds.mean_columns(fitted, RIDGE, 2)
    out = _reach(_scoring(spark, sf_dir)).select("id", *trk.PLAY, (F.col("x_input") + dx).alias("x"), (F.col("y_input") + dy).alias("y"))
    return r6(out, ["x", "y"])


@register("fold_errors")
def q_fold_errors(spark, sf_dir):
    """RMSE of each fold's rows by the member that has not seen them (m5, a10)."""
    s, fitted = _ridge(spark, sf_dir)
    dx, dy = folds.out_of_fold(fitted, RIDGE, 2)
    per = s.select("fold", (F.col("dx") - dx).alias("ex"), (F.col("dy") - dy).alias("ey")).groupBy("fold").agg(
        F.sqrt(F.avg(F.col("ex") ** 2)).alias("rmse_x"), F.sqrt(F.avg(F.col("ey") ** 2)).alias("rmse_y"), F.count("ex").alias("n"))
    return r6(per, ["rmse_x", "rmse_y"])


# Fixed cuts, so that the first split can be worked out in closed form.
STUMP_EDGES = {"x_input": [10.0 * k for k in range(1, 12)], "y_input": [5.0 * k for k in range(1, 11)], "s_input": [1.0 * k for k in range(1, 10)], "a_input": [0.5 * k for k in range(1, 12)]}


@register("boosted_stump")
def q_boosted_stump(spark, sf_dir):
    """The first split of each target's booster over all rows, with its gain a row and its leaves (m1)."""
    settings = boosting.Settings(rounds=1, leaves=2, feature_fraction=1.0, row_fraction=1.0)
    df = _samples(spark, sf_dir)
    model = boosting.fit(df, list(STUMP_EDGES), ["x", "y"], keys=["id"], settings=settings, edges=list(STUMP_EDGES.values()))
    n = df.count()
    rows = [(t, model.features[tree.feature[0]], model.edges[tree.feature[0]][tree.cut[0]], tree.gain[0] / n,
             model.base[t] + tree.value[tree.left[0]], model.base[t] + tree.value[tree.right[0]]) for t, (tree,) in model.trees.items() if tree.feature[0] >= 0]
    out = spark.createDataFrame(rows, "target string, feature string, threshold double, gain_per_row double, pred_left double, pred_right double")
    return r6(out, ["gain_per_row", "pred_left", "pred_right"])


@register("validate_predictions")
def q_validate_predictions(spark, sf_dir):
    """The report over predictions with planted faults: by a rule on the id, rows are dropped, doubled, given a null, an
    infinite or a not-a-number coordinate, or accompanied by a foreign id."""
    s = _scoring(spark, sf_dir)
    rule = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 4), 16, 10).cast("int") % 40
    pred = predict.physics_baseline(s).withColumn("k", rule).where("k != 0")
    pred = pred.withColumns({"x": F.when(F.col("k") == 3, F.lit(float("inf"))).when(F.col("k") != 2, F.col("x")),
                             "y": F.when(F.col("k") == 4, F.lit(float("nan"))).otherwise(F.col("y"))})
    copies = F.when(F.col("k") == 1, F.array("id", "id")).when(F.col("k") == 5, F.array("id", F.concat("id", F.lit("_x"))))
    pred = pred.withColumn("id", F.explode(F.coalesce(copies, F.array("id"))))
    return quality.validate(pred.select("id", *trk.PLAY, "x", "y"), s.select("id", *trk.PLAY))


@register("schema_faults")
def q_schema_faults(spark, sf_dir):
    """What validation reports for predictions with a planted fault of the table as a whole (v1, v3-v6, u3), and for ones
    without play keys of which some rows lack (v2)."""
    s = _scoring(spark, sf_dir)
    good, asked = predict.physics_baseline(s).select("id", *trk.PLAY, "x", "y"), s.select("id", *trk.PLAY)
    kept = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 4), 16, 10).cast("int") % 40 != 0
    cases = {"missing_id": (good.drop("id"), asked), "missing_y": (good.drop("y"), asked), "extra_column": (good.withColumn("z", F.lit(1.0)), asked),
             "text_x": (good.withColumn("x", F.col("x").cast("string")), asked), "empty_prediction": (good.where("false"), asked),
             "empty_request": (good, asked.where("false")), "no_play_key": (good.where(kept).select("id", "x", "y"), asked)}
    reports = [quality.validate(p, r).where("violations > 0").select(F.lit(name).alias("case"), "check", "violations") for name, (p, r) in cases.items()]
    return quality.union_batches(reports)


@register("direction_faults")
def q_direction_faults(spark, sf_dir):
    """Planted direction faults (v9, j5): every third play's direction both ways, every fourth play's unknown."""
    inp, out = _tables(spark, sf_dir)
    play = F.col("game_id") * 10 + F.col("play_id")
    plain = direction.direction_map(inp)
    other = plain.where(play % 3 == 0).withColumn("play_direction", F.when(F.col("play_direction") == "left", "right").otherwise("left"))
    rows = out.drop("week").join(plain.where(play % 4 != 0), trk.PLAY, "left")
    return direction.direction_violations(plain.unionByName(other), rows)


@register("batches_of_plays")
def q_batches_of_plays(spark, sf_dir):
    """Predictions in two batches by play, put together: physics for the held-out plays, zeros for the others (u2, j6, f30)."""
    s = _scoring(spark, sf_dir)
    split = modeling.split_by_play(profile.distinct_plays(_plain(spark, sf_dir)[0]))
    physics = predict.physics_baseline(profile.restrict_to_plays(s, split.where("is_val"))).select("id", *trk.PLAY, "x", "y")
    zeros = predict.zero_baseline(profile.restrict_to_plays(s, split.where("not is_val")))
    return r6(quality.union_batches([physics, zeros]), ["x", "y"])


@register("feature_groups")
def q_feature_groups(spark, sf_dir):
    """The feature columns that are there with each group switched off, with their means (pr13)."""
    samples = _samples(spark, sf_dir)
    parts = []
    for off in ("use_velocity", "use_distance", "use_angle"):
        df = features_a.engineer(samples, is_training=False, **{off: False})
        cols = features_a.present(df, features_a.FEATURES_A)
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
        parts.append(row.select(F.lit(off).alias("off"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in cols]))))
    return r6(quality.union_batches(parts), ["mean"])


def _plain(spark, sf_dir):
    """(input, output) rows without frame numbers: no exchange."""
    t = trk.plain_frames(spark, sf_dir)
    return t.where("is_out = 0"), t.where("is_out = 1")


@register("profile_counts")
def q_profile_counts(spark, sf_dir):
    return profile.counts(_plain(spark, sf_dir)[0])


@register("profile_per_play")
def q_profile_per_play(spark, sf_dir):
    return r6(profile.per_play_stats(*_plain(spark, sf_dir)), ["mean"])


@register("value_counts_topk")
def q_value_counts_topk(spark, sf_dir):
    return profile.value_counts(_plain(spark, sf_dir)[0], ["player_position", "player_side", "player_role"], {"player_position": 10})


def _errors(spark, sf_dir):
    """Errors of the physics baseline, whose predictions are columns of the target rows."""
    rows = state.attach_input_state(trk.tracking_from_events(spark, sf_dir)).withColumn("id", trk.row_id())
    px, py = predict.physics_columns(rows)
    return metrics.errors_of(rows, clip(px, 0.0, predict.FIELD_LENGTH), clip(py, 0.0, predict.FIELD_WIDTH))


@register("error_stats")
def q_error_stats(spark, sf_dir):
    return r6(metrics.error_stats(_errors(spark, sf_dir)), ["mean", "std"])


@register("error_histogram")
def q_error_histogram(spark, sf_dir):
    return r6(metrics.error_histogram(_errors(spark, sf_dir), "error_dist", 50), ["bin_lo", "bin_hi"])


# The library's settings but for the patience: the registered fits stop after 5 rounds without a better held-out error.
PATIENCE = 5


def _gbt(spark, sf_dir):
    """The model of the training rows, and the held-out rows."""
    df = features_a.engineer(_samples(spark, sf_dir), is_training=False)
    train, val, some = modeling.split_frames(df)
    return modeling.train_xy(train, features_a.present(df, features_a.FEATURES_A), val if some else None, patience=PATIENCE), val


@register("gbt_predict")
def q_gbt_predict(spark, sf_dir):
    model, val = _gbt(spark, sf_dir)
    return modeling.predict_xy(model, val).select("id", *trk.PLAY, "x", "y", "pred_x", "pred_y")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _ = _gbt(spark, sf_dir)
    return modeling.feature_importance(model, spark).limit(10)


# ------------------------------------------------------------ files
def _folder(spark, name):
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("weekly_input_files")
def q_weekly_input_files(spark, sf_dir):
    """The input frames written as weekly CSV and read back with the week from the name (io1, io3, u1)."""
    inp, _ = _tables(spark, sf_dir)
    folder = _folder(spark, "weeks")
    files.write_weekly_csv(inp, folder, files.INPUT_PATTERN)
    return files.load_training_data(spark, folder)[0].select(*trk.INPUT_COLUMNS)


@register("weekly_output_files")
def q_weekly_output_files(spark, sf_dir):
    """The output frames of odd weeks, selected when the weekly CSVs are read (io2, u1)."""
    _, out = _tables(spark, sf_dir)
    folder = _folder(spark, "weeks")
    files.write_weekly_csv(out, folder, files.OUTPUT_PATTERN)
    return files.read_weekly(spark, folder, files.OUTPUT_PATTERN, files.OUTPUT_SCHEMA, list(range(1, trk.WEEKS + 1, 2)))


@register("request_files")
def q_request_files(spark, sf_dir):
    """The test pair written as CSV and read back: each request with its player's input rows (io4, io6)."""
    inp, out = _tables(spark, sf_dir)
    folder = _folder(spark, "requests")
    # id first: columns are bound by the header's names, whatever their order
    files.write_request_csv(out.select(trk.row_id().alias("id"), "frame_id", *trk.PLAYER), inp.drop("week"), folder)
    test, inputs = files.load_test_data(spark, folder)
    per = inputs.groupBy(*trk.PLAYER).agg(F.count(F.lit(1)).alias("input_rows"), F.max("frame_id").alias("last_frame"),
                                          F.max("x").alias("max_x"))
    return test.join(per, trk.PLAYER, "left").select("id", *trk.PLAYER, "frame_id", "input_rows", "last_frame", "max_x")


@register("submission_files")
def q_submission_files(spark, sf_dir):
    """Predictions as CSV and as a keyed submission, both read back (io7, io8, j16)."""
    s = _scoring(spark, sf_dir)
    pred = r6(predict.physics_baseline(s).select("id", "x", "y"), ["x", "y"])
    folder = _folder(spark, "submission")
    files.write_predictions_csv(pred, f"{folder}/csv")
    files.write_submission(pred, s.select("id"), f"{folder}/parquet")
    text = spark.read.schema("id string, csv_x double, csv_y double").option("header", True).csv(f"{folder}/csv")
    return spark.read.parquet(f"{folder}/parquet").join(text, "id")


@register("published_submission")
def q_published_submission(spark, sf_dir):
    """Two submissions of one folder, the second with an id predicted twice: the first stays published, with its record,
    and the second leaves a failed one (io8, io9)."""
    s = _scoring(spark, sf_dir)
    pred = r6(predict.physics_baseline(s).select("id", "x", "y"), ["x", "y"])
    folder = _folder(spark, "published")
    version = files.publish_submission(spark, pred, s.select("id"), folder)
    try:
        files.publish_submission(spark, pred.unionByName(pred.where("x >= 0")), s.select("id"), folder)
    except Exception as error:
        if "predicted twice" not in str(error):
            raise
    rows, record = files.read_published(spark, folder)
    runs = files.read_result(spark, f"{folder}/version=*/result").agg(F.count_if("succeeded").alias("good_runs"), F.count_if(~F.col("succeeded")).alias("failed_runs")).first()
    told = {"recorded_rows": record.first()["rows"], "good_runs": runs["good_runs"], "failed_runs": runs["failed_runs"]}
    return rows.select("id", "x", "y", *[F.lit(n).cast("bigint").alias(c) for c, n in told.items()])


@register("quarantined_lines")
def q_quarantined_lines(spark, sf_dir):
    """Weekly files with planted lines that do not parse: rows read and lines set aside, by week (io1)."""
    inp, _ = _tables(spark, sf_dir)
    odd = F.expr("(game_id * 10 + play_id + nfl_id + frame_id) % 50 = 0")
    folder, aside = _folder(spark, "weeks"), _folder(spark, "aside")
    files.write_weekly_csv(inp.withColumn("x", F.when(odd, F.lit("12.3 yards")).otherwise(F.col("x").cast("string"))), folder, files.INPUT_PATTERN)
    good = files.read_weekly(spark, folder, files.INPUT_PATTERN, files.INPUT_SCHEMA, quarantine=aside, most=inp.count())
    bad = spark.read.parquet(aside).select(files.week_of("file").alias("week"), F.lit(0).alias("ok"))
    both = good.select("week", F.lit(1).alias("ok")).unionByName(bad)
    return both.groupBy("week").agg(F.sum("ok").alias("rows_read"), F.count_if(F.col("ok") == 0).alias("lines_aside"))


# ------------------------------------------------------------ streaming
@register("stream_last_state")
def q_stream_last_state(spark, sf_dir):
    return scoring.stream_last_state(spark, _input(spark, sf_dir))


@register("stream_score")
def q_stream_score(spark, sf_dir):
    inp, out = _tables(spark, sf_dir)
    pred = scoring.stream_score(spark, out.select(*trk.PLAYER, "frame_id"), inp)
    return r6(pred.select("id", "game_id", "play_id", "x", "y", "fallback"), ["x", "y"])


ENDED = ["x", "y", "s", "a", "dir", "o", "player_role"]


@register("stream_ended_plays")
def q_stream_ended_plays(spark, sf_dir):
    """Last states given out by a stream when their play has ended (st3, st5); plays start 60 s apart."""
    start = (F.col("game_id") * trk.PLAYS_PER_GAME + F.col("play_id")) * 60
    frames = _input(spark, sf_dir).select(*trk.PLAYER, "frame_id", *ENDED).withColumn(plays.EVENT_TIME, plays.event_time(start))
    root = _folder(spark, "ended")
    source = plays.write_in_time(frames, f"{root}/frames", 4)
    plays.run_ended_plays(spark, source, frames.schema, ENDED, f"{root}/plays", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/plays")


@register("stream_repeated_ids")
def q_stream_repeated_ids(spark, sf_dir):
    """Requests scored in two runs of one stream, the second with every seventh id again: what the reports count (v10)."""
    inp, out = _tables(spark, sf_dir)
    requests = out.select(*trk.PLAYER, "frame_id", trk.row_id().alias("id"))
    root = _folder(spark, "repeated")
    n = 4
    inputs = scoring.write_play_files(inp, f"{root}/inputs", n, rows=inp.count())
    scoring.write_play_files(requests, f"{root}/requests", n)
    scoring.score_stream(spark, f"{root}/requests", requests.schema, inputs, root, n)
    again = requests.where("(game_id * 10 + play_id + nfl_id + frame_id) % 7 = 0")
    scoring.write_play_files(again, f"{root}/requests", n, mode="append")
    scoring.score_stream(spark, f"{root}/requests", requests.schema, inputs, root, 1000)
    reports = spark.read.parquet(f"{root}/reports")
    return reports.groupBy("check").agg(F.sum("violations").alias("violations"))


@register("play_order")
def q_play_order(spark, sf_dir):
    return profile.plays_in_order(trk.plain_frames(spark, sf_dir), "event_id")
