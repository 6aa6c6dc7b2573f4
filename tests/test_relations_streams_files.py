"""Relations within a play, moving averages, streams and the file protocol beyond what the oracle rows show."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import rows_of

from trackframe.functions.batches import pad_histories
from trackframe.operators import interactions, predict, quality, sequences, temporal
from trackframe.plans.queries import REGISTRY
from trackframe.sources import files
from trackframe.sources import tracking as trk
from trackframe.streaming import plays, scoring


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    """Plays of 1 to 30 players with holes: players without a position, direction, side or role, and null keys."""
    rng = np.random.default_rng(4)
    rows = []
    for p, n in enumerate((1, 2, 7, 22, 30)):
        for k in range(n):
            for f in range(1, 4):
                gone = rng.random() < 0.1
                rows.append((1 if rng.random() > 0.02 else None, p, k, f, None if gone else float(rng.integers(0, 40)) / 2, None if gone else float(rng.integers(0, 20)), float(rng.integers(0, 9)),
                             None if rng.random() < 0.2 else float(rng.integers(0, 360)), [None, "Offense", "Defense"][rng.integers(0, 3)],
                             ["Targeted Receiver", "Other Route Runner", "Defensive Coverage", "Passer", None][rng.integers(0, 5)]))
    return spark.createDataFrame(rows, "game_id long, play_id long, nfl_id long, frame_id long, x double, y double, s double, dir double, player_side string, player_role string").repartition(3)


def test_opponents_by_array_by_cells_and_by_window_agree(frames):
    a = interactions.opponent_features(frames)
    want = rows_of(a.toPandas())
    assert want == rows_of(interactions.opponent_features(frames, crowded=True).select(a.columns).toPandas())
    rows = interactions.with_opponent_features(frames)
    joined = frames.join(a, trk.PLAYER, "left").select(rows.columns)
    assert rows_of(rows.toPandas()) == rows_of(joined.toPandas())


def test_opponents_take_no_join(frames):
    for df in (interactions.opponent_features(frames), interactions.with_opponent_features(frames), interactions.propagate(frames, ["s"], 3, x="x", y="y")):
        assert "Join" not in plan(df) and "Cartesian" not in plan(df)


def test_a_play_too_large_for_an_array_is_an_error_not_a_loss(spark, frames, monkeypatch):
    monkeypatch.setattr(interactions, "MAX_MEMBERS", 25)
    with pytest.raises(Exception, match="crowded=True"):
        interactions.opponent_features(frames).collect()
    with pytest.raises(Exception, match="crowded=True"):
        interactions.propagate(frames.where("frame_id = 1"), ["s"], 1, x="x", y="y").collect()
    assert interactions.opponent_features(frames, crowded=True).count() > 0


def test_hops_are_powers_of_the_weighted_graph(frames):
    nodes = frames.where("game_id is not null and frame_id = 2")
    got = interactions.propagate(nodes, ["s", "dir"], 3, radius=6.0, x="x", y="y")
    crowd = interactions.propagate(nodes, ["s", "dir"], 3, radius=6.0, x="x", y="y", crowded=True)
    assert rows_of(got.toPandas()) == rows_of(crowd.select(got.columns).toPandas())
    pdf = nodes.toPandas()
    res = got.toPandas().set_index(["play_id", "nfl_id"])
    for play, part in pdf.groupby("play_id"):
        xy = part[["x", "y"]].to_numpy(float)
        near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)) < 6.0
        w = near / (near.sum(axis=1, keepdims=True) + 1e-8)
        h = part[["s", "dir"]].fillna(0.0).to_numpy(float)
        for k in (1, 2, 3):
            h = w @ h
            got_k = res.loc[[(play, n) for n in part["nfl_id"]], [f"hop{k}_s", f"hop{k}_dir"]].to_numpy()
            assert got_k == pytest.approx(h, abs=1e-9)


@pytest.mark.parametrize("alpha, n", [(0.3, 20_000), (0.01, 3_000), (0.9, 500)])
def test_moving_average_of_long_series_with_gaps(spark, alpha, n):
    rng = np.random.default_rng(2)
    values = [None if rng.random() < 0.4 else float(v) for v in rng.normal(size=n) * 10]
    values[100:400] = [None] * 300
    df = spark.createDataFrame([(1, 1, 1, k, v) for k, v in enumerate(values)], "game_id long, play_id long, nfl_id long, frame_id long, v double")
    out = temporal.ema(df, {"e": "v"}, alpha)
    got = [r["e"] for r in out.orderBy("frame_id").collect()]
    want = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False).mean().tolist()
    assert all((a is None and b != b) or abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert "collect_list" not in plan(out)


def test_sequence_queries_take_one_scan_and_one_exchange(spark):
    for q in ("sequence_train", "sequence_score", "history_arrays", "message_passing"):
        text = plan(REGISTRY[q](spark, SF_SMALL))
        assert text.count("Scan parquet") == 1 and text.count("Exchange hashpartitioning") == 1, q


def test_history_arrays_are_the_long_form(spark):
    t = spark.createDataFrame([(f"{k}", 1, 1, 1, k, int(k > 6), float(k)) for k in range(1, 10)], "id string, game_id long, play_id long, nfl_id long, frame_id long, is_out int, v double")
    got = {r["id"]: r for r in sequences.history_arrays(t, ["v"], max_len=5).collect()}
    assert set(got) == {"7", "8", "9"} and all(r["hist_len"] == 4 and [h[0] for h in r["history"]] == [3, 4, 5, 6] for r in got.values())
    assert pad_histories([got["7"]["history"], [], [[1.0]]], [[7.0], [8.0], [9.0]], 5)[:, :, 0].tolist() == [[3, 4, 5, 6, 7], [0, 0, 0, 0, 8], [0, 0, 0, 1, 9]]
    assert pad_histories([], []).shape[0] == 0


# ---------------------------------------------------------------- streams
@pytest.mark.parametrize("n, per", [(1, 1), (5, 1), (6, 3)])
def test_every_play_is_given_out_once_and_the_state_empties(spark, tmp_dir, n, per):
    inp, _ = trk.tracking_tables(spark, SF_SMALL)
    start = (F.col("game_id") * trk.PLAYS_PER_GAME + F.col("play_id")) * 60
    rows = inp.select(*trk.PLAYER, "frame_id", "x", "dir").withColumn(plays.EVENT_TIME, plays.event_time(start))
    plays.write_in_time(rows, f"{tmp_dir}/in", n)
    q = plays.run_ended_plays(spark, f"{tmp_dir}/in", rows.schema, ["x", "dir"], f"{tmp_dir}/out", f"{tmp_dir}/ckpt", files_per_trigger=per)
    got = spark.read.parquet(f"{tmp_dir}/out")
    want = scoring.partial(inp.select(*trk.PLAYER, "frame_id", "x", "dir"), ["x", "dir"]).select(*trk.PLAYER, "frame_id", "x", "dir")
    assert rows_of(got.drop("frames").toPandas()) == rows_of(want.toPandas())
    assert got.agg(F.sum("frames")).first()[0] == inp.count()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_repeated_ids_are_found_and_replays_are_not(spark, tmp_dir):
    def batch(ids, number):
        df = spark.createDataFrame([(i, b) for i, b in ids], "id string, play_bucket int")
        return scoring.repeated_ids(spark, df, f"{tmp_dir}/ids", number, sorted({b for _, b in ids})).first()["violations"]
    assert batch([("a", 0), ("b", 1)], 0) == 0
    assert batch([("c", 0), ("a", 0)], 1) == 1
    assert batch([("c", 0), ("a", 0)], 1) == 1  # a replay finds what it found before
    assert batch([("a", 0), ("b", 1)], 0) == 0
    assert batch([("b", 1), ("c", 0), ("d", 0), ("d", 0)], 2) == 2


def test_plays_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    whole = rows_of(trk.tracking_from_events(spark, SF_SMALL).toPandas())
    monkeypatch.setattr(trk, "TASK_ROWS", 100)
    t = trk.tracking_from_events(spark, SF_SMALL)
    n = -(-trk.read_table(spark, SF_SMALL, "events").count() // 100)
    assert n > 4 and t.rdd.getNumPartitions() == n
    assert rows_of(t.toPandas()) == whole


def test_histories_are_padded_a_few_at_a_time(spark, monkeypatch):
    from trackframe.plans import queries
    want = rows_of(queries.q_history_arrays(spark, SF_SMALL).toPandas())
    pad = queries.pad_histories

    def few(history, query):
        assert len(query) <= 7
        return pad(history, query)
    monkeypatch.setattr(queries, "PADDED_ROWS", 7, raising=False)
    monkeypatch.setattr(queries, "pad_histories", few)
    assert rows_of(queries.q_history_arrays(spark, SF_SMALL).toPandas()) == want


def test_request_files_follow_the_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (20, 600):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert [scoring.file_count(spark, n) for n in (0, 1_000_000, 24_000_000)] == [8, 8, 96]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_are_written_in_pieces_of_whole_plays(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(scoring, "PIECE_ROWS", 20, raising=False)
    rows = spark.range(400).select((F.col("id") % 50).alias("game_id"), (F.col("id") % 2).alias("play_id"), F.col("id").alias("frame_id"))
    for folder, k in (("pieces", 400), ("whole", 0)):
        back = spark.read.parquet(scoring.write_play_files(rows, f"{tmp_dir}/{folder}", 2, k)).withColumn("file", F.input_file_name())
        files_of = {r["play_bucket"]: r["n"] for r in back.groupBy("play_bucket").agg(F.count_distinct("file").alias("n")).collect()}
        assert set(files_of) == {0, 1} and all(n > 2 if k else n == 1 for n in files_of.values())
        assert back.groupBy(*trk.PLAY).agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
        assert rows_of(back.select(*rows.columns).toPandas()) == rows_of(rows.toPandas())


# ------------------------------------------------------------------ files
def test_a_lost_driver_leaves_the_submission_before(spark, tmp_dir, monkeypatch):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    pred = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, x double, y double")
    files.publish_submission(spark, pred, ids, tmp_dir)
    before = rows_of(files.read_published(spark, tmp_dir)[0].toPandas())
    for step in ("write_result", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(files, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
            with pytest.raises(RuntimeError):
                files.publish_submission(spark, pred.withColumn("x", F.lit(9.0)), ids, tmp_dir)
        rows, record = files.read_published(spark, tmp_dir)
        assert rows_of(rows.toPandas()) == before and record.first()["succeeded"]
    files.publish_submission(spark, pred.withColumn("x", F.lit(9.0)), ids, tmp_dir)
    assert [r["x"] for r in files.read_published(spark, tmp_dir)[0].collect()] == [9.0, 9.0]


def test_an_id_predicted_twice_is_refused(spark, tmp_dir):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    pred = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "id string, x double, y double")
    with pytest.raises(Exception, match="predicted twice: a"):
        files.write_submission(pred, ids, f"{tmp_dir}/s")
    out = files.write_submission(pred.where("x < 2"), ids, f"{tmp_dir}/s").orderBy("id").collect()
    assert [tuple(r) for r in out] == [("a", 1.0, 2.0), ("b", None, None)]


def test_malformed_lines_are_set_aside_up_to_a_bound(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/w")
    with open(f"{tmp_dir}/w/output_2023_w03.csv", "w") as f:
        f.write("game_id,play_id,nfl_id,frame_id,x,y\n1,2,3,1,4.0,5.0\n1,2,3,two,4.0,5.0\n1,2\n1,2,3,4,,\n")
    read = lambda **k: files.read_weekly(spark, f"{tmp_dir}/w", files.OUTPUT_PATTERN, files.OUTPUT_SCHEMA, **k)
    with pytest.raises(Exception):
        read().collect()
    got = read(quarantine=f"{tmp_dir}/bad", most=2)
    assert sorted(r["frame_id"] for r in got.collect()) == [1, 4]
    bad = spark.read.parquet(f"{tmp_dir}/bad")
    assert sorted(r["line"] for r in bad.collect()) == ["1,2", "1,2,3,two,4.0,5.0"]
    assert [r["week"] for r in bad.select(files.week_of("file").alias("week")).distinct().collect()] == [3]
    with pytest.raises(files.TooManyMalformed):
        read(quarantine=f"{tmp_dir}/bad2", most=1)


def test_predictions_without_play_keys_are_checked_by_play(spark):
    asked = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 2)], "id string, game_id long, play_id long")
    pred = spark.createDataFrame([("a", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("z", 0.0, 0.0)], "id string, x double, y double")
    got = {r["check"]: r["violations"] for r in quality.validate(pred, asked).collect()}
    assert (got["missing_ids"], got["extra_ids"], got["duplicate_ids"], got["plays_with_wrong_row_count"]) == (1, 1, 1, 2)


def test_batches_of_other_columns_are_refused(spark):
    a = predict.zero_baseline(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(quality.InvalidSubmission):
        quality.union_batches([a, a.withColumn("x", F.lit(1))])
    with pytest.raises(quality.InvalidSubmission):
        quality.union_batches([])
    assert quality.union_batches([a, a]).count() == 2
