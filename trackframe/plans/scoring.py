"""End-to-end scoring (m10, E3, ud1, f29).

``predict`` is one DataFrame-to-DataFrame function (requests + tracking
inputs -> keyed predictions) used by the batch job and by every streaming
micro-batch.  ``sequence_predict`` scores fixed-length windows with any
pandas/NumPy model through ``mapInPandas``: each row already holds one
player's whole window, so Arrow batches stream through the model with no
grouping, and the model is loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import features_a, modeling, predict as pred_ops, scaling, sequences, state
from trackframe.operators.boosting import Booster
from trackframe.sources import files
from trackframe.sources.tracking import PLAY, PLAYER, row_id

# Member weights of the blend (tree model, sequence model, graph model).
BLEND_WEIGHTS = {"gbdt": 0.3, "transformer": 0.4, "gnn": 0.3}

# A predictor maps keyed request rows to keyed (id, x, y) rows (ud1).
Predictor = Callable[[DataFrame], DataFrame]


def predict(test: DataFrame, test_input: DataFrame, model: Booster | None = None,
            members: dict[str, Predictor] | None = None, weights: dict[str, float] | None = None,
            scaler: DataFrame | None = None) -> DataFrame:
    """Scores every request row (m10): last input state joined to the
    requests, family-A features (scaled when the model's ``scaler`` is given), the boosted trees when given (else the
    physics baseline), blended with any extra member predictors over the
    members present, clipped to the field.  A row without any prediction
    falls back to the field centre and is flagged (f29)."""
    if "id" not in test.columns:
        test = test.withColumn("id", row_id())
    samples = features_a.engineer(state.scoring_samples(test, test_input), is_training=False)
    if model is not None:
        ready = samples
        if scaler is not None:
            ready = scaling.apply_scaler(scaling.finite_features(samples, model.features), scaler, model.features)
        scored = modeling.predict_xy(model, ready)
        base = scored.select("id", *PLAY, F.col("pred_x").alias("x"), F.col("pred_y").alias("y"))
    else:
        base = pred_ops.physics_baseline(samples).select("id", *PLAY, "x", "y")
    if members:
        w = dict(weights or BLEND_WEIGHTS)
        allm = {"gbdt": base, **{k: fn(samples) for k, fn in members.items()}}
        base = pred_ops.blend(allm, w)
        if not all(k in base.columns for k in PLAY):
            base = base.join(test.select("id", *PLAY), "id")
    keys = test.select("id", *PLAY)
    out = keys.join(base.select("id", *PLAY, "x", "y"), ["id", *PLAY], "left")
    out = out.withColumns({
        "fallback": F.col("x").isNull() | F.col("y").isNull(),
        "x": F.coalesce(F.col("x"), F.lit(pred_ops.CENTRE_X)),
        "y": F.coalesce(F.col("y"), F.lit(pred_ops.CENTRE_Y)),
    })
    return pred_ops.clip_to_field(out)


def score_files(spark: SparkSession, folder: str, bundle_path: str, submission_path: str) -> DataFrame:
    """The test pair of ``folder`` and a model bundle to a submission (m10)."""
    test, inputs = files.load_test_data(spark, folder)
    model, scaler = modeling.load_bundle(spark, bundle_path)
    pred = predict(test, inputs, model=model, scaler=scaler)
    return files.write_submission(pred.select("id", "x", "y"), test.select("id"), submission_path)


SequenceModel = Callable[[pd.DataFrame], pd.DataFrame]


def run_sequence_model(windows: DataFrame, cols: list[str], model: SequenceModel,
                       horizon: int = sequences.MAX_HORIZON) -> DataFrame:
    """Apply a pandas sequence model to per-player windows (ud1).

    ``model`` receives a pandas frame with the player keys and ``sequence``
    (list of steps, each a struct with ``features``) and returns the keys with
    ``dx`` and ``dy``: lists of ``horizon`` cumulative offsets.  Output: one
    row per (player, step) with ``dx``, ``dy``.
    """
    arrays = sequences.to_arrays(windows, cols)
    schema = "game_id bigint, play_id bigint, nfl_id bigint, dx array<double>, dy array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)[["game_id", "play_id", "nfl_id", "dx", "dy"]]

    out = arrays.mapInPandas(run, schema)
    return out.select(*PLAYER, F.posexplode(F.arrays_zip("dx", "dy")).alias("step", "d")).select(
        *PLAYER, "step", F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"))


def sequence_predict(test: DataFrame, test_input: DataFrame, fold_models: list[SequenceModel],
                     window: int = sequences.WINDOW_SIZE, horizon: int = sequences.MAX_HORIZON) -> DataFrame:
    """Sequence scoring (E3): family-B windows, each fold model's cumulative
    offsets, their mean per (player, step) (m5), then trajectory
    reconstruction keyed by request id (m7)."""
    if "id" not in test.columns:
        test = test.withColumn("id", row_id())
    feat = sequences.feature_pipeline_b(test_input, window)
    cols = sequences.feature_columns_b(feat)
    win = sequences.scoring_windows(feat, test, cols, window)
    steps = None
    for i, m in enumerate(fold_models):
        s = run_sequence_model(win, cols, m, horizon).withColumn("fold", F.lit(i))
        steps = s if steps is None else steps.unionByName(s)
    mean = steps.groupBy(*PLAYER, "step").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    anchors = sequences.last_step(win, window).select(*PLAYER, "play_direction", "last_x", "last_y")
    return sequences.reconstruct(test.select("id", *PLAYER, "frame_id"), mean, anchors, horizon)


def constant_velocity_model(cols: list[str], horizon: int = sequences.MAX_HORIZON,
                            dt: float = 0.1) -> SequenceModel:
    """A NumPy sequence model: the last step's velocity carried forward.
    ``cols`` is the window's feature order (must hold velocity_x/velocity_y).
    The zero-training baseline, and a test double for a trained network."""
    import numpy as np

    ix, iy = cols.index("velocity_x"), cols.index("velocity_y")

    def model(b: pd.DataFrame) -> pd.DataFrame:
        k = np.arange(1, horizon + 1, dtype=float) * dt
        last = [seq[-1]["features"] for seq in b["sequence"]]
        vx = np.array([f[ix] for f in last], dtype=float)
        vy = np.array([f[iy] for f in last], dtype=float)
        out = b[["game_id", "play_id", "nfl_id"]].copy()
        out["dx"] = [list(v * k) for v in vx]
        out["dy"] = [list(v * k) for v in vy]
        return out

    return model
