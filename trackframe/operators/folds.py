"""Fold ensembles: per-fold scalers and linear members from one pass, boosted members side by side (m5, a13, a14).

A fold's moments (rows, means, centred cross products of features and targets) are merged from partial ones of any rows,
so a single pass gives those of all folds.  What a member learns from, all rows but one fold's, is the merge of the
other folds' moments: neither a pass per fold nor a subtraction of large sums.  Its scaler and its ridge coefficients
follow in closed form.  The members' mean is a linear function of the features, hence one native expression.

What comes to the driver is (folds x width^2) numbers whatever the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import finite_or_zero
from trackframe.operators import boosting
from trackframe.operators.boosting import Booster, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need not have this package


@dataclass
class Moments:
    """Rows, means and centred cross products of some columns."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])
        away = rows - mean
        return cls(float(len(rows)), mean, away.T @ away)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.cross + other.cross + np.outer(step, step) * (self.n * other.n / n))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.cross.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, width: int) -> Moments:
        v = np.frombuffer(raw, float)
        return cls(float(v[0]), v[1:1 + width], v[1 + width:].reshape(width, width))


def merged(parts: list[Moments], width: int) -> Moments:
    total = Moments(0.0, np.zeros(width), np.zeros((width, width)))
    for part in parts:
        total = total.merge(part)
    return total


def fold_moments(df: DataFrame, features: list[str], targets: list[str], fold: str = "fold") -> dict[int, Moments]:
    """Moments of features and targets of each fold, in one pass; a row without a finite target is left out."""
    width = len(features) + len(targets)
    usable = [F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")) & (F.abs(F.col(t).cast("double")) != float("inf")) for t in targets]
    rows = df.where(F.forall(F.array(F.lit(True), *usable), lambda ok: ok)).select(
        F.col(fold).cast("int").alias("fold"), F.array(*[finite_or_zero(f) for f in features], *[F.col(t).cast("double") for t in targets]).alias("z"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Moments] = {}
        for b in batches:
            z, of = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), b.column("fold").to_numpy(zero_copy_only=False)
            for k in np.unique(of):
                part = Moments.of(z[of == k])
                seen[int(k)] = seen[int(k)].merge(part) if int(k) in seen else part
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([m.to_bytes() for m in seen.values()], pa.binary())], ["fold", "m"])

    def whole(part: pa.Table) -> pa.Table:
        total = merged([Moments.from_bytes(m, width) for m in part["m"].to_pylist()], width)
        return pa.table({"fold": part["fold"][:1], "m": pa.array([total.to_bytes()], pa.binary())})
    parts = rows.mapInArrow(partial, "fold int, m binary").groupBy("fold").applyInArrow(lambda t: whole(t), "fold int, m binary")
    return {r["fold"]: Moments.from_bytes(bytes(r["m"]), width) for r in parts.collect()}


@dataclass
class Member:
    """What a fold's member learned from the other folds: the scaler, and ridge coefficients of the scaled features."""

    fold: int
    rows: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # [targets, features]
    intercept: np.ndarray


def members(per: dict[int, Moments], n_features: int, folds: int, penalty: float = 1.0) -> list[Member]:
    """One member for each of ``folds`` (0 and up) that leaves rows to learn from: standard scaling (the scale of a constant counts as 1) and ridge regression with an unpenalised
    intercept, the squared error being a sum over rows, from the moments of all other folds."""
    out = []
    width = len(next(iter(per.values())).mean) if per else 0
    for fold in range(folds):
        m = merged([per[k] for k in sorted(per) if k != fold], width)
        if m.n == 0:
            continue
        scale = np.sqrt(np.diag(m.cross)[:n_features] / m.n)
        scale = np.where(scale <= 10 * np.finfo(float).eps * np.abs(m.mean[:n_features]), 1.0, scale)
        gram = m.cross[:n_features, :n_features] / np.outer(scale, scale)
        weights = np.linalg.solve(gram + penalty * np.eye(n_features), m.cross[:n_features, n_features:] / scale[:, None]).T
        out.append(Member(fold, int(m.n), m.mean[:n_features], scale, weights, m.mean[n_features:]))
    return out


def scalers(spark, fitted: list[Member], features: list[str]) -> DataFrame:
    """(fold, feature, mean, scale, rows): the statistics that a fold's member scales with."""
    rows = [(m.fold, f, float(a), float(s), m.rows) for m in fitted for f, a, s in zip(features, m.mean, m.scale)]
    return spark.createDataFrame(rows, "fold int, feature string, mean double, scale double, rows long")


def member_columns(m: Member, features: list[str]) -> list[Column]:
    """A member's prediction of each target as a native expression."""
    out = []
    for w, b in zip(m.weights, m.intercept):
        per = w / m.scale
        start = F.lit(float(b - (per * m.mean).sum()))
        out.append(sum((finite_or_zero(f) * float(c) for f, c in zip(features, per)), start))
    return out


def mean_columns(fitted: list[Member], features: list[str], targets: int) -> list[Column]:
    """The mean of all members' predictions of each target: linear functions have a linear mean.  Null without a member."""
    if not fitted:
        return [F.lit(None).cast("double")] * targets
    per = np.mean([m.weights / m.scale for m in fitted], axis=0)
    start = np.mean([m.intercept - (m.weights / m.scale) @ m.mean for m in fitted], axis=0)
    return [sum((finite_or_zero(f) * float(c) for f, c in zip(features, own)), F.lit(float(b))) for own, b in zip(per, start)]


def out_of_fold(fitted: list[Member], features: list[str], targets: int, fold: str = "fold") -> list[Column]:
    """Each row's prediction by the member that has not seen its fold; null in a fold without a member."""
    out = []
    for t in range(targets):
        choice = F.lit(None).cast("double")
        for m in fitted:
            choice = F.when(F.col(fold) == m.fold, member_columns(m, features)[t]).otherwise(choice)
        out.append(choice)
    return out


def boosted_folds(df: DataFrame, features: list[str], targets: list[str], k: int, fold: str = "fold", keys: list[str] | None = None,
                  settings: Settings = Settings()) -> Booster:
    """A boosted model per target and fold, each stopped by the fold it does not learn from, all grown in the same passes."""
    models = {f"{t}_{i}": (F.col(t), F.col(fold) == i) for t in targets for i in range(k)}
    return boosting.fit_models(df, features, models, keys, settings)


def boosted_mean(model: Booster, df: DataFrame, targets: list[str], k: int) -> DataFrame:
    """``df`` with ``pred_<target>``, the mean of the folds' models."""
    scored = boosting.predict(model, df)
    means = [(sum((F.col(f"pred_{t}_{i}") for i in range(k)), F.lit(0.0)) / k).alias(f"pred_{t}") for t in targets]
    return scored.select(*df.columns, *means)
