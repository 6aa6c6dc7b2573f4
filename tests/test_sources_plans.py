"""File sources/sinks and the end-to-end jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from helpers import rows_of
from trackframe.operators import predict as pred_ops
from trackframe.plans import scoring, training
from trackframe.plans.queries import REGISTRY
from trackframe.sources import files
from trackframe.sources import tracking as trk
from trackframe.streaming import scoring as stream


def _write_weekly(spark, folder):
    # sf0.01 holds two games, so two weeks
    inp, out = trk.tracking_tables(spark, SF_MID)
    for wk in (1, 2):
        sub_i = inp.where(F.col("week") == wk).drop("week")
        sub_o = out.where(F.col("week") == wk).drop("week")
        cols = [f.name for f in files.INPUT_SCHEMA.fields]
        sub_i = sub_i.select(*[F.col(c) if c in sub_i.columns else F.lit(None).cast("string").alias(c) for c in cols])
        sub_i.coalesce(1).write.option("header", True).csv(f"{folder}/tmp_in_{wk}")
        sub_o.coalesce(1).write.option("header", True).csv(f"{folder}/tmp_out_{wk}")
        for kind, tmp in (("input", f"tmp_in_{wk}"), ("output", f"tmp_out_{wk}")):
            part = [p for p in os.listdir(f"{folder}/{tmp}") if p.endswith(".csv")][0]
            os.link(f"{folder}/{tmp}/{part}", f"{folder}/{kind}_2023_w{wk:02d}.csv")
    return inp, out


def test_weekly_csv_roundtrip(spark, tmp_dir):
    inp, out = _write_weekly(spark, tmp_dir)
    rin, rout = files.load_training_data(spark, tmp_dir)
    assert rin.count() == inp.where(F.col("week").isin(1, 2)).count()
    assert sorted(r[0] for r in rin.select("week").distinct().collect()) == [1, 2]
    only2, _ = files.load_training_data(spark, tmp_dir, weeks=[2])
    assert only2.count() == inp.where(F.col("week") == 2).count()
    assert rout.count() == out.where(F.col("week").isin(1, 2)).count()


def test_empty_glob_raises(spark, tmp_dir):
    with pytest.raises(files.NoTrackingFiles):
        files.load_training_data(spark, tmp_dir)


def test_submission_is_keyed_and_result_record_cut(spark, tmp_dir):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    pred = spark.createDataFrame([("b", 2.0, 3.0), ("a", 1.0, 4.0)], "id string, x double, y double")
    out = files.write_submission(pred, ids, f"{tmp_dir}/sub")
    got = {r["id"]: (r["x"], r["y"]) for r in spark.read.parquet(f"{tmp_dir}/sub").collect()}
    assert got == {"a": (1.0, 4.0), "b": (2.0, 3.0)} and out.columns[0] == "id"
    files.write_result(spark, f"{tmp_dir}/res", ValueError("x" * 9000))
    rec = spark.read.json(f"{tmp_dir}/res").first()
    assert rec["succeeded"] is False and len(rec["error_details"]) == 8000


def test_predict_end_to_end_matches_physics_query(spark):
    inp, out = trk.tracking_tables(spark, SF_SMALL)
    pred = scoring.predict(out.select(*trk.PLAYER, "frame_id"), inp)
    want = REGISTRY["physics_baseline"](spark, SF_SMALL).select("id", "x", "y")
    got = pred.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    a = {r["id"]: (r["x"], r["y"]) for r in got.collect()}
    b = {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in want.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k][0] - b[k][0]) < 1e-5 and abs(a[k][1] - b[k][1]) < 1e-5 for k in a)


def test_sequence_predict_with_numpy_model(spark):
    inp, out = trk.tracking_tables(spark, SF_SMALL)
    test = out.select(*trk.PLAYER, "frame_id")
    from trackframe.operators import sequences
    cols = sequences.feature_columns_b(sequences.feature_pipeline_b(inp))
    model = scoring.constant_velocity_model(cols)
    pred = scoring.sequence_predict(test, inp, [model, model])
    assert pred.count() == test.count()
    bad = pred.where(F.col("x").isNull() | (F.col("x") < 0) | (F.col("x") > 120)).count()
    assert bad <= test.join(inp.select(*trk.PLAYER).distinct(), trk.PLAYER, "left_anti").count()


def test_train_job_and_bundle_roundtrip(spark, tmp_dir):
    inp, out = trk.tracking_tables(spark, SF_MID)
    res = training.train_gbdt(inp, out, bundle_path=f"{tmp_dir}/bundle", rounds=3, leaves=7)
    rep = res.report.first()
    assert rep["n"] > 0 and rep["rmse"] >= 0
    assert res.importance.count() == len(res.model.features)
    assert rep["rounds_x"] == len(res.model.trees["x"]) <= 3
    from trackframe.operators import modeling
    model, scaler = modeling.load_bundle(spark, f"{tmp_dir}/bundle")
    assert scaler.first().asDict() == pytest.approx(res.scaler.first().asDict())
    assert model == res.model
    p = scoring.predict(out.select(*trk.PLAYER, "frame_id"), inp, model=model, scaler=scaler)
    assert p.where(F.col("x").isNull()).count() == 0
    # a validation row is scored from the bundle as the training job scored it
    own = res.validation.select("id", "pred_x", "pred_y")
    both = pred_ops.clip_to_field(own, "pred_x", "pred_y").join(p, "id").toPandas()
    assert len(both) == rep["n"] and both["pred_x"].values == pytest.approx(both["x"].values) and both["pred_y"].values == pytest.approx(both["y"].values)


def test_jobs_from_files_to_submission(spark, tmp_dir):
    inp, out = trk.tracking_tables(spark, SF_MID)
    _write_weekly(spark, str(tmp_dir))
    files.write_request_csv(out.select(trk.row_id().alias("id"), "frame_id", *trk.PLAYER), inp.drop("week"), f"{tmp_dir}/request")
    res = training.train_from_files(spark, str(tmp_dir), f"{tmp_dir}/bundle", rounds=2, leaves=4)
    assert res.report.first()["n"] > 0
    scoring.score_files(spark, f"{tmp_dir}/request", f"{tmp_dir}/bundle", f"{tmp_dir}/submission")
    got = spark.read.parquet(f"{tmp_dir}/submission").toPandas()
    assert sorted(got["id"]) == sorted(r["id"] for r in out.select(trk.row_id().alias("id")).collect())
    assert got[["x", "y"]].notna().all().all()


def test_an_empty_training_side_is_an_error(spark):
    from trackframe.operators import modeling
    one = spark.createDataFrame([(2024090100, 1)], "game_id long, play_id long")
    side = modeling.split_by_play(one).first()["is_val"]
    if side:
        with pytest.raises(modeling.EmptyTrainingSplit):
            modeling.split_frames(one)
    else:
        train, val, some = modeling.split_frames(one)
        assert train.count() == 1 and val.count() == 0 and not some
    with pytest.raises(modeling.EmptyTrainingSplit):
        modeling.split_frames(one, val_ratio=1.0)


@pytest.mark.parametrize("files,per_trigger", [(1, 1), (7, 1), (7, 3)])
def test_stream_equals_batch_for_any_batch_size(spark, files, per_trigger):
    """st3, st5: every player, for any number of files and batches."""
    inp, out = trk.tracking_tables(spark, SF_MID)
    want = REGISTRY["last_state"](spark, SF_MID)
    done: list[int] = []
    got = stream.stream_last_state(spark, inp, per_trigger, files, done)
    buckets = stream.with_bucket(inp.select(*trk.PLAY), files).select(stream.BUCKET).distinct().count()
    assert len(done) == -(-buckets // per_trigger) and (files == 1 or len(done) > 1)
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())


def test_partial_states_merge_whatever_the_cut(spark):
    """Halves of plays in any order, nulls in between: the merged state is the whole one."""
    inp, _ = trk.tracking_tables(spark, SF_SMALL)
    holes = inp.withColumn("s", F.when(F.col("frame_id") % 3 != 0, F.col("s")))
    cols = [c for c in inp.columns if c not in trk.PLAYER and c != "frame_id"]
    late = stream.partial(holes.where("frame_id % 2 = 0"), cols).unionByName(stream.partial(holes.where("frame_id % 2 = 1"), cols))
    assert rows_of(stream.merged(late, inp.columns, cols).toPandas()) == rows_of(stream.partial(holes, cols).select(*inp.columns).toPandas())


def test_stream_score_reads_only_its_buckets(spark):
    inp, out = trk.tracking_tables(spark, SF_SMALL)
    want = scoring.predict(out.select(*trk.PLAYER, "frame_id"), inp)
    got = stream.stream_score(spark, out.select(*trk.PLAYER, "frame_id"), inp, 1, 5)
    assert rows_of(got.select("id", "x", "y").toPandas()) == rows_of(want.select("id", "x", "y").toPandas())


def test_csv_columns_bind_by_name(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/csv")
    with open(f"{tmp_dir}/csv/test.csv", "w") as f:
        f.write("game_id,play_id,nfl_id,frame_id,id\n7,8,9,10,a\n")
    with open(f"{tmp_dir}/csv/test_input.csv", "w") as f:
        f.write("x,game_id,play_id,nfl_id,frame_id,other\n1.5,7,8,9,10,z\n")
    test, inputs = files.load_test_data(spark, f"{tmp_dir}/csv")
    assert test.first().asDict() == {"id": "a", "game_id": 7, "play_id": 8, "nfl_id": 9, "frame_id": 10}
    assert inputs.columns == files.INPUT_SCHEMA.names
    assert inputs.first()["x"] == 1.5 and inputs.first()["game_id"] == 7 and inputs.first()["y"] is None


def test_missing_output_files_twice(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/weeks")
    with open(f"{tmp_dir}/weeks/input_2023_w01.csv", "w") as f:
        f.write("game_id,play_id\n1,2\n")
    for _ in range(2):
        _, out = files.load_training_data(spark, f"{tmp_dir}/weeks")
        assert out.columns == ["game_id", "play_id", "nfl_id", "frame_id", "x", "y", "week"]
        assert dict(out.dtypes)["week"] == "int"
    assert files.OUTPUT_SCHEMA.names == ["game_id", "play_id", "nfl_id", "frame_id", "x", "y"]


def test_two_directions_fail_and_never_multiply(spark):
    from trackframe.operators import direction
    rows = spark.createDataFrame([(1, 1, 5.0, 6.0), (1, 2, 5.0, 6.0)], "game_id long, play_id long, x double, y double")
    both = spark.createDataFrame([(1, 1, "left"), (1, 1, "right"), (1, 2, "right")], "game_id long, play_id long, play_direction string")
    assert direction.apply_direction(rows, both.where("play_id = 2")).count() == 2
    with pytest.raises(Exception, match="two directions in play 1/1"):
        direction.apply_direction(rows, both).collect()


def test_weekly_folders_and_files_read_alike(spark, tmp_dir):
    inp, _ = trk.tracking_tables(spark, SF_SMALL)
    files.write_weekly_csv(inp, f"{tmp_dir}/a", files.INPUT_PATTERN)
    back, out = files.load_training_data(spark, f"{tmp_dir}/a")
    assert rows_of(back.select(*trk.INPUT_COLUMNS).toPandas()) == rows_of(inp.toPandas()) and out.count() == 0
    with pytest.raises(files.NoTrackingFiles):
        files.read_weekly(spark, f"{tmp_dir}/a", files.OUTPUT_PATTERN, files.OUTPUT_SCHEMA)


def test_blend_of_columns_is_blend_of_frames(spark):
    from trackframe.operators import predict
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 5.0), ("b", None, 2.0, 3.0, None), ("c", None, None, None, None)],
                                 "id string, px double, py double, qx double, qy double")
    weights = {"p": 0.25, "q": 0.5}
    x, y = predict.blend_columns({"p": (F.col("px"), F.col("py")), "q": (F.col("qx"), F.col("qy"))}, weights)
    frames = {m: rows.select("id", F.col(f"{m}x").alias("x"), F.col(f"{m}y").alias("y")) for m in "pq"}
    assert rows_of(rows.select("id", x.alias("x"), y.alias("y")).toPandas()) == rows_of(predict.blend(frames, weights).toPandas())


def test_value_counts_bound_per_column(spark):
    from trackframe.operators import profile
    rows = spark.createDataFrame([(f"v{i % 15}", i % 15) for i in range(40)], "s string, n int")
    for k, want in (({"n": 10}, {"s": 15, "n": 10}), (None, {"s": 15, "n": 15}), (4, {"s": 4, "n": 4})):
        got = [r["column"] for r in profile.value_counts(rows, ["s", "n"], k).collect()]
        assert {c: got.count(c) for c in want} == want


def test_value_counts_ties_nulls_and_bound(spark):
    from trackframe.operators import profile
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", 3), (None, 3), ("c", 3)], "s string, n int")
    got = [tuple(r) for r in profile.value_counts(rows, ["s", "n"], 3).orderBy("column", "rank").collect()]
    assert got == [("n", "3", 3, 1), ("n", "1", 2, 2), ("n", "2", 1, 3), ("s", "a", 2, 1), ("s", "b", 2, 2), ("s", "c", 1, 3)]


def test_model_comparison_leaves_rows_without_a_prediction_out(spark):
    from trackframe.operators import metrics
    rows = spark.createDataFrame([(3.0, 4.0, 3.0), (0.0, 0.0, None)], "x double, y double, p double")
    got = {r["model"]: r for r in metrics.compare_models(rows, {"zero": (F.lit(0.0), F.lit(0.0)), "p": (F.col("p"), F.col("p"))}).collect()}
    assert got["zero"]["n"] == 2 and got["zero"]["rmse_x"] == pytest.approx(4.5 ** 0.5) and got["zero"]["rmse_y"] == pytest.approx(8 ** 0.5)
    assert got["p"]["n"] == 1 and got["p"]["rmse_x"] == 0 and got["p"]["rmse_y"] == 1


def test_fold_offsets_of_a_frame_without_training_rows(spark):
    from trackframe.operators import modeling
    train = spark.createDataFrame([(1, p, 1, 1.0 + p, 2.0, 0.0, 0.0) for p in range(20)],
                                  "game_id long, play_id long, frame_id long, x double, y double, x_input double, y_input double")
    requests = spark.createDataFrame([("a", 1, 10.0, 20.0), ("b", 2, 10.0, 20.0), ("c", 1, None, 20.0)], "id string, frame_id long, x_input double, y_input double")
    got = {r["id"]: r for r in modeling.fold_mean_model(train, requests).collect()}
    assert got["a"]["members"] == 5 and got["a"]["y"] == 22.0 and 11 < got["a"]["x"] < 30
    assert got["b"]["members"] == 0 and got["b"]["x"] is None and got["c"]["x"] is None and got["c"]["y"] == 22.0
