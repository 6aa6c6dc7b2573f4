"""Model training and scoring (m1-m5, m8, io10).

* Train/validation split and fold ids are deterministic functions of the play
  key (an md5 of ``game_play_seed``), so they need no shuffle, no driver-side
  list of plays, and give the same answer in any engine.
* Boosted trees are grown by ``operators.boosting``: best leaf first over
  histograms summed on the executors, with patience on the validation plays.
* The fold ensemble fits one small model per fold on the other folds' plays
  and averages the members per frame.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import boosting
from trackframe.operators.boosting import Booster
from trackframe.session import cut_lineage
from trackframe.sources.tracking import FRAME, PLAY, play_key

MEMBER_ROWS = 100_000  # rows of (frame, offsets) that may be broadcast, about 4 MB


def play_hash(seed: int | str, salt: str = "") -> F.Column:
    """An integer in [0, 2**32) from md5(game_play_seed[salt])."""
    parts = [play_key(), F.lit(str(seed))]
    if salt:
        parts.append(F.lit(salt))
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8), 16, 10).cast("bigint")


def split_by_play(df: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_val`` for every row, the same for all rows of a play (m2)."""
    return df.withColumn("is_val", play_hash(seed) < F.lit(int(val_ratio * 2 ** 32)))


class EmptyTrainingSplit(ValueError):
    """No play fell to the training side of the split."""


def split_frames(df: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame, bool]:
    """(train, validation, whether validation has rows) by play.  Validation rows are never training rows: with few
    plays the validation frame may be empty, and reports over it have n = 0; an empty training side is an error."""
    flagged = split_by_play(df, val_ratio, seed)
    n = flagged.agg(F.count_if(F.col("is_val")).alias("v"), F.count_if(~F.col("is_val")).alias("t")).first()
    if n["t"] == 0:
        raise EmptyTrainingSplit(f"no training play at val_ratio={val_ratio}, seed={seed}")
    return flagged.where(~F.col("is_val")), flagged.where(F.col("is_val")), n["v"] > 0


def fold_of_play(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` in 0..k-1 per play (m5)."""
    return df.withColumn("fold", F.pmod(play_hash(seed, "fold"), F.lit(k)).cast("int"))


def train_xy(train: DataFrame, features: list[str], val: DataFrame | None = None, seed: int = 42, **settings) -> Booster:
    """A model for x and one for y on finite-or-zero features (m1), fitted side by side.  With a validation frame, each
    stops when its error there has not improved for the patience's rounds, and ends with its best round."""
    cols = [*features, *[c for c in ("id", *FRAME, "nfl_id") if c in train.columns and c not in features], *[c for c in ("x", "y") if c not in features]]
    data = train.select(*cols, F.lit(False).alias("_held"))
    if val is not None:
        data = data.unionByName(val.select(*cols, F.lit(True).alias("_held")))
    keys = ["id"] if "id" in train.columns else [c for c in cols if c not in ("x", "y")]
    return boosting.fit(data, features, ["x", "y"], "_held" if val is not None else None, keys, boosting.Settings(seed=seed, **settings))


def predict_xy(model: Booster, df: DataFrame) -> DataFrame:
    """Both models' predictions as columns ``pred_x``, ``pred_y`` (m3)."""
    return boosting.predict(model, df)


def feature_importance(model: Booster, spark) -> DataFrame:
    """Total gain of each feature in each model and their mean, most important first (m4, s2); one row per feature."""
    gain = boosting.importance(model)
    rows = [(f, a, b, (a + b) / 2) for f, a, b in zip(model.features, gain["x"], gain["y"])]
    df = spark.createDataFrame(rows, "feature string, importance_x double, importance_y double, importance_avg double")
    return df.orderBy(F.col("importance_avg").desc(), F.col("feature"))


def validation_report(pred: DataFrame) -> DataFrame:
    """RMSE of x, y and combined on the validation rows (a10)."""
    mx = F.avg((F.col("x") - F.col("pred_x")) ** 2)
    my = F.avg((F.col("y") - F.col("pred_y")) ** 2)
    return pred.agg(F.sqrt(mx).alias("rmse_x"), F.sqrt(my).alias("rmse_y"),
                    F.sqrt(0.5 * (mx + my)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def fold_mean_model(train: DataFrame, requests: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Five-fold ensemble of a per-frame mean-displacement model (m5).

    Fold f's member is fitted on the plays outside fold f: the mean offset
    (target minus last input position) per output frame.  Training rows are
    reduced to sums by (frame, fold), a member adds up the other folds' sums,
    and the members' mean is one offset per frame.  Requests neither multiply
    nor regroup: that table is joined to them by frame, broadcast while its
    counted rows are at most ``MEMBER_ROWS``.  One row per request row.
    """
    t = fold_of_play(train, k, seed).select(
        "fold", "frame_id", (F.col("x") - F.col("x_input")).alias("dx"), (F.col("y") - F.col("y_input")).alias("dy"))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    sums = t.groupBy("frame_id", "fold").agg(F.sum("dx").alias("sx"), F.count("dx").alias("nx"),
                                             F.sum("dy").alias("sy"), F.count("dy").alias("ny"))
    members = (sums.withColumn("member", F.explode(others)).groupBy("member", "frame_id")
               .agg(F.try_divide(F.sum("sx"), F.sum("nx")).alias("mdx"), F.try_divide(F.sum("sy"), F.sum("ny")).alias("mdy")))
    offsets = cut_lineage(members.groupBy("frame_id").agg(F.avg("mdx").alias("ox"), F.avg("mdy").alias("oy"),
                                                          F.count("mdx").alias("members")))
    if offsets.count() <= MEMBER_ROWS:
        offsets = F.broadcast(offsets)
    j = requests.join(offsets, "frame_id", "left")
    keys = [c for c in ("id", *PLAY) if c in requests.columns]
    return j.select(*keys, (F.col("x_input") + F.col("ox")).alias("x"), (F.col("y_input") + F.col("oy")).alias("y"),
                    F.coalesce("members", F.lit(0).cast("bigint")).alias("members"))


def save_bundle(model: Booster, scaler: DataFrame | None, path: str, spark) -> None:
    """The model as JSON and the scaler statistics under one folder (io10); features and settings travel with the model."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "model"))
    if scaler is not None:
        scaler.write.mode("overwrite").parquet(os.path.join(path, "scaler"))


def load_bundle(spark, path: str) -> tuple[Booster, DataFrame | None]:
    model = Booster.from_json(spark.read.text(os.path.join(path, "model"), wholetext=True).first()["value"])
    try:
        scaler = spark.read.parquet(os.path.join(path, "scaler"))
    except AnalysisException:  # saved without a scaler
        scaler = None
    return model, scaler
