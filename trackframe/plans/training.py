"""End-to-end training job (E1: m8, m9).

read -> last state + samples -> family-A features -> numeric coercion ->
split by play -> scaling -> boosted trees for x and y (patience on the held-out
plays) -> validation RMSE and feature importance -> model bundle.  The features
are scaled with the training side's statistics, which go into the bundle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import features_a, modeling, scaling, state
from trackframe.operators.boosting import Booster
from trackframe.sources import files


@dataclass
class TrainResult:
    model: Booster
    report: DataFrame  # held-out error, and the round that each model ends with
    importance: DataFrame
    validation: DataFrame  # with id and predictions; its feature columns (frame_id too) are scaled
    scaler: DataFrame


def training_frame(inp: DataFrame, out: DataFrame, include_all_players: bool = False) -> DataFrame:
    samples = state.training_samples(inp, out, include_all_players)
    feats = features_a.engineer(samples, is_training=True)
    return scaling.coerce_numeric(feats, features_a.present(feats, features_a.FEATURES_A))


def train_gbdt(inp: DataFrame, out: DataFrame, val_ratio: float = 0.2, seed: int = 42,
               bundle_path: str | None = None, **settings) -> TrainResult:
    """Train, evaluate and report (m8); save the bundle when a path is given (io10)."""
    df = training_frame(inp, out)
    feats = features_a.present(df, features_a.FEATURES_A)
    train, val, some = modeling.split_frames(df, val_ratio, seed)
    train, val = scaling.finite_features(train, feats), scaling.finite_features(val, feats)
    fitted = scaling.fit_scaler(train, feats)
    scaler = df.sparkSession.createDataFrame(fitted.collect(), fitted.schema)  # one row: two numbers a feature
    train, val = scaling.apply_scaler(train, scaler, feats), scaling.apply_scaler(val, scaler, feats)
    model = modeling.train_xy(train, feats, val if some else None, seed=seed, **settings)
    scored = modeling.predict_xy(model, val)
    report = modeling.validation_report(scored).withColumns({f"rounds_{t}": F.lit(len(trees)) for t, trees in model.trees.items()})
    importance = modeling.feature_importance(model, df.sparkSession)
    if bundle_path:
        modeling.save_bundle(model, scaler, bundle_path, df.sparkSession)
    return TrainResult(model, report, importance, scored, scaler)


def train_from_files(spark: SparkSession, folder: str, bundle_path: str, weeks: list[int] | None = None,
                     **params) -> TrainResult:
    """The weekly CSV files of ``folder`` to a model bundle (m9)."""
    inp, out = files.load_training_data(spark, folder, weeks)
    return train_gbdt(inp, out, bundle_path=bundle_path, **params)
