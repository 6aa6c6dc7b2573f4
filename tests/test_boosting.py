"""The boosted trees against a small brute-force booster, and the fold members against direct fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import boosting, folds
from trackframe.operators.boosting import Booster, Settings


def best_first(bins, residual, leaves, least, rate):
    """A tree grown one split at a time; (splits in order as (path, feature, cut, gain), value of each row)."""
    def split(rows):
        best = None
        for f in range(bins.shape[1]):
            for cut in range(bins[:, f].max()):
                left = rows & (bins[:, f] <= cut)
                right = rows & ~left
                a, b = left.sum(), right.sum()
                if min(a, b) < least:
                    continue
                gain = residual[left].sum() ** 2 / a + residual[right].sum() ** 2 / b - residual[rows].sum() ** 2 / rows.sum()
                if gain > 0 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, cut, left, right
        return best
    everything = np.ones(len(bins), bool)
    open_leaves = {(): (everything, split(everything))}
    order = []
    while len(open_leaves) < leaves and any(s for _, s in open_leaves.values()):
        path = max((p for p, (_, s) in open_leaves.items() if s), key=lambda p: open_leaves[p][1][0])
        gain, f, cut, left, right = open_leaves.pop(path)[1]
        order.append((path, f, cut, gain))
        open_leaves[(*path, 0)], open_leaves[(*path, 1)] = (left, split(left)), (right, split(right))
    value = np.zeros(len(bins))
    for rows, _ in open_leaves.values():
        value[rows] = rate * residual[rows].mean()
    return order, value


def brute_booster(bins, y, held, s):
    f = np.full(len(y), y[~held].mean())
    gains, errors, preds = np.zeros(bins.shape[1]), [np.sqrt(((y - f)[held] ** 2).mean())], [f.copy()]
    gain_rounds = [gains.copy()]
    while len(preds) <= s.rounds and len(errors) - 1 - int(np.argmin(errors)) < s.patience:
        order, _ = best_first(bins[~held], (y - f)[~held], s.leaves, s.least_rows, s.rate)
        leaf = {}
        where = [()] * len(y)
        splits = {p: (feat, cut) for p, feat, cut, _ in order}
        for i in range(len(y)):
            while where[i] in splits:
                feat, cut = splits[where[i]]
                where[i] = (*where[i], int(bins[i, feat] > cut))
        for p in set(where):
            rows = np.array([w == p for w in where]) & ~held
            leaf[p] = s.rate * (y - f)[rows].mean()
        f = f + np.array([leaf[p] for p in where])
        for _, feat, _, gain in order:
            gains[feat] += gain
        gain_rounds.append(gains.copy())
        preds.append(f.copy())
        errors.append(np.sqrt(((y - f)[held] ** 2).mean()))
    end = int(np.argmin(errors))
    return end, errors, preds[end], gain_rounds[end]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(420, 4)).round(2)
    y1 = 3 * np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=420) * 0.3
    y2 = np.abs(x[:, 3]) * 2 + rng.normal(size=420) * 2
    held = rng.random(420) < 0.25
    rows = [(i, *map(float, x[i]), float(y1[i]), float(y2[i]), bool(held[i])) for i in range(420)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y1 double, y2 double, held boolean").repartition(5)
    return df, x, {"y1": y1, "y2": y2}, held


def test_booster_is_brute_force(spark, table):
    df, x, targets, held = table
    s = Settings(rounds=12, patience=3, leaves=9, rate=0.3, feature_fraction=1.0, row_fraction=1.0, bins=12, least_rows=8)
    model = boosting.fit(df, ["a", "b", "c", "d"], list(targets), "held", ["id"], s)
    bins = boosting.to_bins(x, model.edges).astype(int)
    got = boosting.predict(model, df).orderBy("id").toPandas()
    for t, y in targets.items():
        end, errors, pred, gains = brute_booster(bins, y, held, s)
        assert len(model.trees[t]) == end == model.best(t)["round"]
        assert [h["rmse"] for h in model.history if h["target"] == t] == pytest.approx(errors)
        assert model.best(t)["rmse"] == pytest.approx(min(errors))
        assert got[f"pred_{t}"].to_numpy() == pytest.approx(pred)
        assert boosting.importance(model)[t] == pytest.approx(gains.tolist())
    assert any(len(model.trees[t]) < s.rounds for t in targets)  # patience stopped one of them


def test_booster_survives_a_round_trip_and_a_refresh(spark, table, monkeypatch):
    df, *_ = table
    s = Settings(rounds=5, patience=50, leaves=5, least_rows=8)
    model = boosting.fit(df, ["a", "b"], ["y1"], "held", ["id"], s)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    again = boosting.fit(df.repartition(3), ["a", "b"], ["y1"], "held", ["id"], s)
    back = Booster.from_json(again.to_json())
    assert back == again and [h["rmse"] for h in again.history] == pytest.approx([h["rmse"] for h in model.history])
    p = boosting.predict(back, df).select("id", "pred_y1").orderBy("id").toPandas()["pred_y1"]
    assert p.to_numpy() == pytest.approx(boosting.predict(model, df).orderBy("id").toPandas()["pred_y1"].to_numpy())


def test_booster_of_nothing_and_of_constants(spark, table):
    df, *_ = table
    s = Settings(rounds=2, least_rows=1)
    empty = boosting.fit(df.limit(0), ["a"], ["y1"], "held", ["id"], s)
    assert boosting.predict(empty, df).select("pred_y1").distinct().collect()[0][0] == 0.0
    flat = boosting.fit(df.withColumns({"a": F.lit(None).cast("double"), "y1": F.when(F.col("id") > 5, 7.0)}), ["a"], ["y1"], None, ["id"], s)
    assert [r[0] for r in boosting.predict(flat, df).select("pred_y1").distinct().collect()] == [7.0]
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], ["y1"], settings=Settings(bins=500))


def test_fold_members_are_direct_fits(spark, table):
    df, x, targets, _ = table
    df = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    fold = np.arange(420) % 3
    y = np.stack(list(targets.values()), axis=1)
    fitted = folds.members(folds.fold_moments(df, ["a", "b", "c", "d"], ["y1", "y2"]), 4, 3, penalty=2.0)
    assert [m.fold for m in fitted] == [0, 1, 2] and [m.rows for m in fitted] == [280, 280, 280]
    all_preds = []
    for m in fitted:
        own = x[fold != m.fold]
        z = (own - own.mean(axis=0)) / own.std(axis=0)
        assert m.mean == pytest.approx(own.mean(axis=0)) and m.scale == pytest.approx(own.std(axis=0))
        target = y[fold != m.fold]
        w = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (target - target.mean(axis=0)))
        assert m.weights == pytest.approx(w.T) and m.intercept == pytest.approx(target.mean(axis=0))
        all_preds.append(((x - own.mean(axis=0)) / own.std(axis=0)) @ w + target.mean(axis=0))
    a, b = folds.mean_columns(fitted, ["a", "b", "c", "d"], 2)
    got = df.select("id", a.alias("p"), b.alias("q")).orderBy("id").toPandas()[["p", "q"]].to_numpy()
    assert got == pytest.approx(np.mean(all_preds, axis=0))
    a, b = folds.out_of_fold(fitted, ["a", "b", "c", "d"], 2)
    got = df.select("id", a.alias("p"), b.alias("q")).orderBy("id").toPandas()[["p", "q"]].to_numpy()
    assert got == pytest.approx(np.stack([all_preds[k][i] for i, k in enumerate(fold)]))


def test_boosted_folds_are_single_fits(spark, table):
    df, *_ = table
    df = df.withColumn("fold", (F.col("id") % 2).cast("int"))
    s = Settings(rounds=4, patience=2, leaves=5, feature_fraction=1.0, row_fraction=1.0, least_rows=8)
    edges = boosting.bin_edges(df, ["a", "b"], 16)
    both = boosting.fit_models(df, ["a", "b"], {f"y1_{k}": (F.col("y1"), F.col("fold") == k) for k in range(2)}, ["id"], s, edges)
    for k in range(2):
        one = boosting.fit(df.withColumn("held", F.col("fold") == k), ["a", "b"], ["y1"], "held", ["id"], s, edges)
        assert [h["rmse"] for h in one.history] == pytest.approx([h["rmse"] for h in both.history if h["target"] == f"y1_{k}"])
    model = folds.boosted_folds(df, ["a", "b"], ["y1"], 2, keys=["id"], settings=s)
    got = folds.boosted_mean(model, df, ["y1"], 2).orderBy("id").toPandas()
    parts = boosting.predict(model, df).orderBy("id").toPandas()
    assert got.columns.tolist() == [*df.columns, "pred_y1"] and got["pred_y1"].to_numpy() == pytest.approx((parts["pred_y1_0"] + parts["pred_y1_1"]).to_numpy() / 2)
