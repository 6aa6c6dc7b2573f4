"""Hand-made rows for the null rules n1-n11 and the defaults (f12, j12, f29)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackframe.functions import nulls
from trackframe.operators import features_b, state, temporal


def test_last_non_null_per_column(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 1, 10.0, "a"), (1, 1, 1, 2, None, "b"), (1, 1, 1, 3, 30.0, None)],
        "game_id long, play_id long, nfl_id long, frame_id long, x double, tag string")
    row = state.last_state(df).first()
    assert row["x"] == 30.0 and row["tag"] == "b" and row["frame_id"] == 3


def test_null_group_key_is_dropped(spark):
    df = spark.createDataFrame([(1, 1, None, 1, 1.0), (1, 1, 2, 1, 2.0)],
                               "game_id long, play_id long, nfl_id long, frame_id long, x double")
    assert state.last_state(df).count() == 1


def test_least_propagates_null_and_flag_zero(spark):
    r = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "a double, b double").select(
        nulls.nan_least("a", "b").alias("m"), nulls.flag(F.col("a") < 3).alias("f")).collect()
    assert r[0]["m"] is None and r[0]["f"] == 0
    assert r[1]["m"] == 1.0 and r[1]["f"] == 1


def test_floor_mod(spark):
    v = spark.range(1).select(nulls.floor_mod(F.lit(-30.0), 360.0).alias("m")).first()["m"]
    assert v == 330.0


def test_diff_filled_zero_on_first_and_null(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1.0), (1, 1, 1, 2, None), (1, 1, 1, 3, 4.0)],
                               "game_id long, play_id long, nfl_id long, frame_id long, v double")
    w = temporal.player_window()
    got = [r["d"] for r in df.select("frame_id", nulls.diff_filled("v", w).alias("d")).orderBy("frame_id").collect()]
    assert got == [0.0, 0.0, 0.0]


def test_rolling_std_one_row_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0.5, 0.5, 1.0, 1.0)],
                               "game_id long, play_id long, nfl_id long, frame_id long, velocity_x double, "
                               "velocity_y double, s double, a double")
    r = temporal.rolling_multi(df).first()
    assert r["s_std3"] == 0.0 and r["s_roll3"] == 1.0


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, 4.0],
    [None, 1.0, None, None, 5.0, 2.0],
    [2.0, None, 4.0, None, None, None, 1.0, 1.0],
    [None, None],
])
def test_ema_matches_pandas(spark, values):
    rows = [(1, 1, 1, i + 1, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "game_id long, play_id long, nfl_id long, frame_id long, v double")
    got = [r["e"] for r in temporal.ema(df, {"e": "v"}).select("frame_id", "e").orderBy("frame_id").collect()]
    want = pd.Series(values, dtype=float).ewm(alpha=0.3, adjust=False).mean().tolist()
    for g, w in zip(got, want):
        if math.isnan(w):
            assert g is None
        else:
            assert g == pytest.approx(w, abs=1e-12)


def test_ema_long_series_bounded_frame(spark):
    values = list(np.sin(np.arange(400) / 7.0))
    rows = [(1, 1, 1, i + 1, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "game_id long, play_id long, nfl_id long, frame_id long, v double")
    got = [r["e"] for r in temporal.ema(df, {"e": "v"}).select("frame_id", "e").orderBy("frame_id").collect()]
    want = pd.Series(values).ewm(alpha=0.3, adjust=False).mean().tolist()
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("text, feet", [("6-2", 6 + 2 / 12), ("5-11", 5 + 11 / 12), ("bad", 6.0), (None, 6.0),
                                        ("6-", 6.0), ("6-2-1", 6.0), ("-6-2", 6.0)])
def test_height_parse(spark, text, feet):
    v = spark.createDataFrame([(text,)], "player_height string").select(features_b.height_feet()).first()[0]
    assert v == pytest.approx(feet)


def test_numeric_coerce_and_finite(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("x", float("inf")), (None, None)], "a string, b double")
    r = df.select(nulls.numeric_or_zero("a").alias("a"), nulls.finite_or_zero("b").alias("b")).collect()
    assert [x["a"] for x in r] == [1.5, 0.0, 0.0]
    assert [x["b"] for x in r] == [0.0, 0.0, 0.0]


def test_physics_fallback_to_centre(spark):
    from trackframe.operators import predict
    df = spark.createDataFrame([("a", 1, 1, 1, None, None, None, None), ("b", 1, 1, 5, 10.0, 20.0, 1.0, 0.0)],
                               "id string, game_id long, play_id long, frame_id long, x_input double, "
                               "y_input double, s_input double, dir_input double")
    r = {x["id"]: x for x in predict.physics_baseline(df).collect()}
    assert (r["a"]["x"], r["a"]["y"], r["a"]["fallback"]) == (50.0, 26.65, True)
    assert r["b"]["x"] == pytest.approx(10.5) and r["b"]["y"] == pytest.approx(20.0) and not r["b"]["fallback"]


@pytest.mark.parametrize("gaps", [[1], [3], [109], [110], [111], [500], [3] * 60, [7, 120, 2, 300]])
def test_ema_over_any_gap(spark, gaps):
    import pandas as pd
    values = [None, None]
    for i, g in enumerate(gaps):
        values += [float(i * 7 % 11), float(i % 5)] + [None] * g
    values += [4.0, None]
    df = spark.createDataFrame([(1, 1, 1, k, v) for k, v in enumerate(values)], "game_id long, play_id long, nfl_id long, frame_id long, v double")
    got = [r["e"] for r in temporal.ema(df, {"e": "v"}).orderBy("frame_id").collect()]
    want = pd.Series(values, dtype=float).ewm(alpha=0.3, adjust=False).mean().tolist()
    assert all((a is None and b != b) or abs(a - b) < 1e-9 for a, b in zip(got, want))
