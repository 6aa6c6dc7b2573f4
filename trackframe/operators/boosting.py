"""Boosted regression trees grown best leaf first over histograms, with patience on held-out plays (m1, m3, m4).

The rows stay on the executors as one byte per feature (the number of the feature's bin), the targets and a hash for
bagging.  A pass is one job: each task walks its rows down the trees as they stand, sums gradient and count by (target,
leaf, feature, bin) in numpy, and the sums meet by (target, leaf), where the best split of the leaf is picked.  Only that
one row per leaf comes to the driver.

Best-first growth takes one split at a time, but needs no pass for each: the driver plays the priority queue with the
splits it knows and asks for the children of all leaves that it would split, in one pass; known children can only push
later choices out, so the play is repeated until every chosen split has known children.  That is the best-first tree
exactly, in about as many passes as it is deep.  All targets grow in the same passes.

After each round the held-out error is measured in the next round's first pass.  A target that has not bettered its best
error for ``patience`` rounds stops, and its model ends with its best round.  Every ``REFRESH`` rounds the rows are
written with their predictions so far, so that a pass evaluates few trees.

Tables are written by ``checkpoint`` and every pass is a plain job over them, so lost executors cost a task's repeat.
A histogram has (features x bins) cells whatever the rows.  Rows without a target value teach nothing.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.nulls import finite_or_zero
from trackframe.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need not have this package

REFRESH = 20
ACCURACY = 10_000


@dataclass(frozen=True)
class Settings:
    """Defaults: rate 0.05, 63 leaves, 0.8 of the features per tree, 0.8 of the rows drawn anew every 5 rounds."""

    rounds: int = 1000
    patience: int = 50
    leaves: int = 63
    rate: float = 0.05
    feature_fraction: float = 0.8
    row_fraction: float = 0.8
    redraw: int = 5
    bins: int = 64
    least_rows: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1.  Rows with bin <= ``cut`` go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, empty in zip((self.feature, self.cut, self.left, self.right, self.value, self.gain), (-1, 0, -1, -1, 0.0, 0.0)):
            part.append(empty)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` [rows, features]."""
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            here = at[live]
            at[live] = np.where(bins[live, feature[here]] <= cut[here], left[here], right[here])
            live = live[feature[at[live]] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Booster:
    features: list[str]
    edges: list[list[float]]
    settings: Settings
    base: dict[str, float]
    trees: dict[str, list[Tree]]
    history: list[dict]  # target, round (trees so far), rmse on the held-out rows

    def best(self, target: str) -> dict | None:
        """The history entry of the round that the target's model ends with."""
        own = [h for h in self.history if h["target"] == target]
        return min(own, key=lambda h: (h["rmse"], h["round"])) if own else None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Booster:
        raw = json.loads(text)
        trees = {t: [Tree(**tree) for tree in own] for t, own in raw["trees"].items()}
        return cls(raw["features"], raw["edges"], Settings(**raw["settings"]), raw["base"], trees, raw["history"])


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` rising cuts per feature, from approximate quantiles in one aggregate (bounded by features x bins)."""
    at = [i / bins for i in range(1, bins)]
    rows = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, ACCURACY).alias(f"q{k}") for k, f in enumerate(features)],
                  *[F.max(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)]).first()
    return [sorted({c for c in rows[f"q{k}"] or [] if c < rows[f"m{k}"]}) for k in range(len(features))]


def to_bins(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: how many cuts lie below it."""
    return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2 ** 64 - 1))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)) / 2.0 ** 53


def best_split(hist: np.ndarray, allowed: np.ndarray, least: int) -> tuple[int, int, float, float, float]:
    """(feature, cut, gain, gradient sum, rows) of a leaf from its histogram [features, bins, (gradient, rows)]; no split: feature -1."""
    total, n = hist[allowed[0]].sum(axis=0)
    run = hist[allowed].cumsum(axis=1)
    g, c = run[:, :-1, 0], run[:, :-1, 1]
    fits = (c >= least) & (n - c >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, g ** 2 / c + (total - g) ** 2 / (n - c) - total ** 2 / n, -np.inf)
    if not gain.size or not gain.max() > 0:
        return -1, 0, 0.0, float(total), float(n)
    k = int(np.argmax(gain))
    f, cut = divmod(k, gain.shape[1])
    return int(allowed[f]), cut, float(gain.flat[k]), float(total), float(n)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def binned(df: DataFrame, features: list[str], edges: list[list[float]], values: list[Column], held: list[Column], keys: list[str]) -> DataFrame:
    """bins, a hash of ``keys``, and for each target whether the row is held out, its value and the prediction so far."""
    rows = df.select(F.array(*[finite_or_zero(f) for f in features]).alias("v"), F.xxhash64(*keys).alias("key"), F.array(*held).alias("held"),
                     F.array(*[F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values]).alias("y"))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.tobytes() for r in to_bins(_pair(b, "v", width), edges)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("key"), b.column("held"), b.column("y"), b.column("y")], ["bins", "key", "held", "y", "f"])
    return rows.mapInArrow(run, "bins binary, key long, held array<boolean>, y array<double>, f array<double>")


def _pair(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def advanced(rows: DataFrame, trees: list[list[Tree]], base: list[float] | None, width: int) -> DataFrame:
    """``rows`` with the predictions moved on by ``trees`` (or set to ``base`` first)."""
    k = len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _matrix(b, width)
            f = np.tile(np.array(base), (len(bins), 1)) if base is not None else _pair(b, "f", k).copy()
            for t, own in enumerate(trees):
                for tree in own:
                    f[:, t] += tree.predict(bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(f) * k + 1, k, dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], ["bins", "key", "held", "y", "f"])
    return rows.mapInArrow(run, rows.schema)


def scan(rows: DataFrame, recent: list[list[Tree]], growing: list[Tree | None], wanted: list[list[int]], allowed: list[np.ndarray],
         shape: tuple[int, int], bag: tuple[float, int], least: int) -> dict[tuple[int, int], tuple]:
    """One pass: the best split of each wanted leaf, {(target, node): (feature, cut, gain, gradient, rows)}.

    ``recent``: trees that the rows' predictions lack; node -1 gives the held-out squared error and rows.
    """
    width, bins = shape
    share, salt = bag

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {(t, node): np.zeros(width * bins * 2) for t, nodes in enumerate(wanted) for node in nodes if growing[t] is not None}
        error = np.zeros((len(growing), 2))
        for b in batches:
            x = _matrix(b, width)
            y, f = _pair(b, "y", len(growing)), _pair(b, "f", len(growing)).copy()
            away = _pair(b, "held", len(growing)).astype(bool)
            drawn = _uniform(b.column("key").to_numpy(zero_copy_only=False), salt) < share
            for t, tree in enumerate(growing):
                if tree is None:
                    continue
                for old in recent[t]:
                    f[:, t] += old.predict(x)
                known, held = ~np.isnan(y[:, t]), away[:, t]
                residual = y[:, t] - f[:, t]
                if 0 in wanted[t]:
                    error[t] += (residual[held & known] ** 2).sum(), (held & known).sum()
                use = drawn & known & ~held
                leaf, xs, g = tree.leaf_of(x[use]), x[use], residual[use]
                for node in wanted[t]:
                    mine = leaf == node
                    cell = (xs[mine] + np.arange(width) * bins).ravel()
                    hist[t, node] += np.stack([np.bincount(cell, np.repeat(g[mine], width), width * bins), np.bincount(cell, None, width * bins)], axis=1).ravel()
        keys = [*hist, *[(t, -1) for t in range(len(growing)) if growing[t] is not None and 0 in wanted[t]]]
        cells = [*[h.tobytes() for h in hist.values()], *[error[t].tobytes() for t, node in keys if node == -1]]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(cells, pa.binary())], ["target", "node", "h"])

    def pick(part: pa.Table) -> pa.Table:
        t, node = part["target"][0].as_py(), part["node"][0].as_py()
        total = sum(np.frombuffer(h, float) for h in part["h"].to_pylist())
        got = (-1, 0, 0.0, total[0], total[1]) if node == -1 else best_split(total.reshape(width, bins, 2), allowed[t], least)
        return pa.table({"target": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([got[0]], pa.int32()),
                         "cut": pa.array([got[1]], pa.int32()), "gain": [got[2]], "g": [got[3]], "n": [got[4]]})
    found = rows.mapInArrow(sums, "target int, node int, h binary").groupBy("target", "node").applyInArrow(
        lambda part: pick(part), "target int, node int, feature int, cut int, gain double, g double, n double")
    return {(r["target"], r["node"]): (r["feature"], r["cut"], r["gain"], r["g"], r["n"]) for r in found.collect()}


class _Growth:
    """One target's tree while it grows: the splits known so far and the priority queue's play."""

    def __init__(self, settings: Settings):
        self.tree, self.settings, self.known, self.children = Tree(), settings, {}, {}
        self.trail = {self.tree.add(): ()}

    def chosen(self) -> list[int]:
        """The nodes that best-first growth splits, as far as splits are known, in its order."""
        queue, out = [], []
        def push(node: int) -> None:
            if node in self.known and self.known[node][0] >= 0:
                heapq.heappush(queue, (-self.known[node][2], self.trail[node], node))
        push(0)
        while queue and len(out) + 1 < self.settings.leaves:
            node = heapq.heappop(queue)[2]
            out.append(node)
            for child in self.children.get(node, ()):
                push(child)
        return out

    def open(self) -> list[int]:
        """Split the chosen nodes that are not split yet; their children, which the next pass must look at."""
        fresh = []
        for node in self.chosen():
            if node not in self.children:
                pair = tuple(self.tree.add() for _ in range(2))
                self.children[node] = pair
                self.tree.feature[node], self.tree.cut[node] = self.known[node][:2]
                self.tree.left[node], self.tree.right[node] = pair
                for side, child in enumerate(pair):
                    self.trail[child] = (*self.trail[node], side)
                fresh += pair
        return fresh

    def finished(self) -> Tree:
        """The tree of the chosen splits alone, with leaf values."""
        split, out = set(self.chosen()), Tree()

        def copy(node: int) -> int:
            at = out.add()
            _, _, gain, g, n = self.known.get(node, (-1, 0, 0.0, 0.0, 0.0))  # no rows at all
            out.value[at] = self.settings.rate * g / n if n else 0.0
            if node in split:
                out.feature[at], out.cut[at], out.gain[at] = *self.known[node][:2], gain
                left, right = self.children[node]
                out.left[at] = copy(left)
                out.right[at] = copy(right)
            return at
        copy(0)
        return out


def fit(df: DataFrame, features: list[str], targets: list[str], held: str | None = None, keys: list[str] | None = None,
        settings: Settings = Settings(), edges: list[list[float]] | None = None) -> Booster:
    """A model per target column, fitted on the rows where ``held`` is false; ``keys`` identify a row for bagging."""
    out = F.col(held) if held else F.lit(False)
    if edges is None:
        edges = bin_edges(df.where(~out), features, settings.bins)
    return fit_models(df, features, {t: (F.col(t), out) for t in targets}, keys, settings, edges)


def fit_models(df: DataFrame, features: list[str], models: dict[str, tuple[Column, Column]], keys: list[str] | None = None,
               settings: Settings = Settings(), edges: list[list[float]] | None = None) -> Booster:
    """Models fitted side by side, each by its name with its target and its condition for held-out rows."""
    if not 2 <= settings.bins <= 256:
        raise ValueError("a bin is one byte: 2 to 256 bins")
    edges = edges if edges is not None else bin_edges(df, features, settings.bins)
    width, bins = len(features), max([2, *(len(e) + 1 for e in edges)])
    targets, values, held = list(models), [v for v, _ in models.values()], [h for _, h in models.values()]
    means = df.agg(*[F.avg(F.when(~h, v)).alias(f"m{k}") for k, (v, h) in enumerate(zip(values, held))]).first()
    base = [float(means[f"m{k}"] or 0.0) for k in range(len(targets))]
    rows = cut_lineage(advanced(binned(df, features, edges, values, held, keys or features), [[] for _ in targets], base, width))
    model = Booster(list(features), [list(e) for e in edges], settings, dict(zip(targets, base)), {t: [] for t in targets}, [])
    recent: list[list[Tree]] = [[] for _ in targets]
    best = [(float("inf"), 0)] * len(targets)
    live = [True] * len(targets)
    pool = np.arange(width)
    for step in range(settings.rounds + 1):
        rng = np.random.default_rng([settings.seed, step])
        allowed = [np.sort(rng.choice(pool, max(1, round(settings.feature_fraction * width)), replace=False)) for _ in targets]
        growth = [_Growth(settings) if on else None for on in live]
        wanted: list[list[int]] = [[0] if on else [] for on in live]
        bag = (settings.row_fraction, settings.seed * 1_000_003 + step // settings.redraw)
        while any(wanted):
            got = scan(rows, recent, [g.tree if g else None for g in growth], wanted, allowed, (width, bins), bag, settings.least_rows)
            for (t, node), split in sorted(got.items()):
                if node >= 0:
                    if live[t]:
                        growth[t].known[node] = split
                elif split[4] > 0:  # the model of ``step`` trees on the held-out rows
                    rmse = float(np.sqrt(split[3] / split[4]))
                    model.history.append({"target": targets[t], "round": step, "rmse": rmse})
                    best[t] = min(best[t], (rmse, step))
                    if step - best[t][1] >= settings.patience:
                        live[t], growth[t] = False, None
            if step == settings.rounds:
                live = [False] * len(targets)
            wanted = [g.open() if g and on else [] for g, on in zip(growth, live)]
        if not any(live):
            break
        for t, g in enumerate(growth):
            if g:
                recent[t].append(g.finished())
                model.trees[targets[t]].append(recent[t][-1])
        if (step + 1) % REFRESH == 0:
            rows, recent = cut_lineage(advanced(rows, recent, None, width)), [[] for _ in targets]
    for t in targets:
        if (end := model.best(t)) is not None:
            model.trees[t] = model.trees[t][:end["round"]]
    return model


def predict(model: Booster, df: DataFrame) -> DataFrame:
    """``df`` with a column ``pred_<target>`` for each target."""
    names = [f"pred_{t}" for t in model.trees]

    def run(values: pd.Series) -> pd.DataFrame:
        bins = to_bins(np.stack(values.to_numpy()), model.edges) if len(values) else np.zeros((0, len(model.edges)), np.uint8)
        out = {n: model.base[t] + sum((tree.predict(bins) for tree in trees), np.zeros(len(bins))) for n, (t, trees) in zip(names, model.trees.items())}
        return pd.DataFrame(out)
    scored = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(F.array(*[finite_or_zero(f) for f in model.features]))
    return df.withColumn("_scored", scored).select(*df.columns, *[F.col(f"_scored.{n}").alias(n) for n in names])


def importance(model: Booster) -> dict[str, list[float]]:
    """Total gain by feature, for each target."""
    out = {}
    for target, trees in model.trees.items():
        total = np.zeros(len(model.features))
        for tree in trees:
            split = np.array(tree.feature) >= 0
            np.add.at(total, np.array(tree.feature)[split], np.array(tree.gain)[split])
        out[target] = total.tolist()
    return out
