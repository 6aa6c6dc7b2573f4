"""Fixed-length sequences, targets and trajectories (q1-q7, w12-w14, m7).

Sequences are kept in long form - one row per (player, step) with the feature
columns - which is what Spark partitions, sorts and joins well; ``to_arrays``
builds the ``ARRAY<STRUCT<step, frame_id, features>>`` a model consumes, over
groups bounded by the window length.  All windows key on the player, so on
play-partitioned input nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators import direction, features_b, interactions, temporal
from trackframe.operators.features_a import present
from trackframe.operators.predict import FIELD_LENGTH, FIELD_WIDTH
from trackframe.functions.nulls import clip
from trackframe.sources.tracking import PLAY, PLAYER

# Input window length and longest prediction horizon (frames).
WINDOW_SIZE = 12
MAX_HORIZON = 94


def feature_pipeline_b(inp: DataFrame, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Direction unify -> base -> opponents -> lags/EMA/rolling -> advanced
    features (q1): windows over the same play-partitioned rows throughout, so
    one scan and one exchange."""
    base = features_b.base_features(direction.unify_left(inp))
    lagged = temporal.lag_block(interactions.with_opponent_features(base), window_size)
    return features_b.advanced_features(lagged)


def feature_columns_b(df: DataFrame) -> list[str]:
    """Family-B model features present in ``df`` (pr6)."""
    return present(df, features_b.FEATURES_B)


def tail_window(df: DataFrame, n: int = WINDOW_SIZE) -> DataFrame:
    """Last ``n`` frames per player with ``step`` 0..n-1 (oldest first) and the
    group's row count ``group_rows`` (w12)."""
    # rank from the end via the ascending order the lag windows already sort by
    asc = Window.partitionBy(*PLAYER).orderBy("frame_id")
    whole = Window.partitionBy(*PLAYER)
    t = df.withColumns({"_rn": F.row_number().over(asc), "group_rows": F.count(F.lit(1)).over(whole)})
    t = t.withColumn("_rd", F.col("group_rows") - F.col("_rn") + 1).drop("_rn")
    t = t.where(F.col("_rd") <= n)
    return t.withColumn("step", (F.least(F.col("group_rows"), F.lit(n)) - F.col("_rd")).cast("int")).drop("_rd")


def _frame_key(cols: list[str]) -> list[str]:
    """``frame_id`` as a key column unless it is one of the features (then the
    feature, filled like the others, carries it)."""
    return [] if "frame_id" in cols else ["frame_id"]


def _windowed(feat: DataFrame, requests: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The requested players' rows, narrowed to the keys and features, with the
    whole-group means (a4; booleans count as 0/1, n8), the group size and the
    rank from the end, in one projection (one Window operator over the player
    sort)."""
    fk = _frame_key(cols)
    f = feat if requests is None else feat.join(requests.select(*PLAYER).distinct(), PLAYER, "left_semi")
    asc = Window.partitionBy(*PLAYER).orderBy("frame_id")
    whole = Window.partitionBy(*PLAYER)
    size = F.count(F.lit(1)).over(whole)
    t = f.select(*PLAYER, *fk, "play_direction", *[F.col(c).cast("double").alias(c) for c in cols],
                 *[F.avg(F.col(c).cast("double")).over(whole).alias(f"_m_{c}") for c in cols],
                 size.alias("group_rows"), (size - F.row_number().over(asc) + 1).alias("_rd"))
    return t.where(F.col("_rd") <= n)


def training_windows(feat: DataFrame, targets: DataFrame | None, cols: list[str],
                     n: int = WINDOW_SIZE) -> DataFrame:
    """Training sequences in long form (q2): players with output rows and at
    least ``n`` input frames; the last ``n`` frames, nulls filled with the
    whole-group mean; a player with any null left is dropped.  With
    ``targets=None`` every player with input gets a window (a later keyed
    join to the targets selects)."""
    # a value is still null after the fill only if its column is null in the
    # whole group (its mean is null), so the drop rule reads the means
    bad = F.greatest(*[F.col(f"_m_{c}").isNull() for c in cols])
    t = _windowed(feat, targets, cols, n).where((F.col("group_rows") >= n) & ~bad)
    return t.select(*PLAYER, (F.lit(n) - F.col("_rd")).cast("int").alias("step"), *_frame_key(cols),
                    "play_direction", *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in cols])


def scoring_windows(feat: DataFrame, requests: DataFrame | None, cols: list[str],
                    n: int = WINDOW_SIZE) -> DataFrame:
    """Scoring sequences in long form (q3): every requested player with input
    frames gets exactly ``n`` steps; missing leading steps are pad rows equal
    to the group mean; what is still null becomes 0.  ``requests=None`` makes
    windows for every player with input (a later keyed join selects)."""
    fk = _frame_key(cols)
    t = _windowed(feat, requests, cols, n)
    # One pass, no union: the oldest kept row of a short group also emits the
    # pad rows before it (k < n - group_rows), every other row emits itself.
    short = F.col("group_rows") < n
    oldest = F.col("_rd") == F.col("group_rows")
    k = F.explode(F.when(oldest & short, F.sequence(F.lit(0), F.lit(n) - F.col("group_rows")))
                  .otherwise(F.array(F.lit(-1))))
    t = t.withColumn("_k", k)
    pad = (F.col("_k") >= 0) & (F.col("_k") < F.lit(n) - F.col("group_rows"))
    return t.select(
        *PLAYER,
        F.when(pad, F.col("_k")).otherwise(F.lit(n) - F.col("_rd")).cast("int").alias("step"),
        *[F.when(~pad, F.col(c)).alias(c) for c in fk],
        F.when(~pad, F.col("play_direction")).alias("play_direction"),
        *[F.coalesce(F.when(~pad, F.col(c)), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) for c in cols])


def last_step(windows: DataFrame, n: int = WINDOW_SIZE) -> DataFrame:
    """The last row of each window: frame, direction and unified last position."""
    return windows.where(F.col("step") == n - 1).select(
        *PLAYER, "frame_id", "play_direction", F.col("x").alias("last_x"), F.col("y").alias("last_y"))


def target_deltas(out: DataFrame, windows: DataFrame, n: int = WINDOW_SIZE) -> DataFrame:
    """Target offsets from the last input position, in unified coordinates (q4):
    one row per output frame of every player with a training window.  The
    play direction comes with the window's last step (one per play), so the
    output rows need no separate direction-map join."""
    last = last_step(windows, n).drop("frame_id")
    t = direction.unify_left(out.drop("play_direction").join(last, PLAYER, "inner"))
    return t.select(*PLAYER, "frame_id", "play_direction",
                    (F.col("x") - F.col("last_x")).alias("dx"), (F.col("y") - F.col("last_y")).alias("dy"))


def to_arrays(windows: DataFrame, cols: list[str]) -> DataFrame:
    """Long-form windows to one row per player with the ordered step array
    (groups are at most the window length)."""
    step = F.struct("step", "frame_id", F.array(*[F.col(c) for c in cols]).alias("features"))
    return windows.groupBy(*PLAYER).agg(F.sort_array(F.collect_list(step)).alias("sequence"))


def history_sequences(history: DataFrame, samples: DataFrame, cols: list[str],
                      max_len: int = 100) -> DataFrame:
    """History + query sequences in long form (q5): the player's input rows
    (by frame) followed by the sample's own feature row, the last ``max_len``
    kept, left-padded with zero rows; a player without history gets one zero
    row before the query.  Keyed by the sample ``id``, ``pos`` 0..max_len-1."""
    h = history.select(*PLAYER, "frame_id", *[F.col(c).cast("double").alias(c) for c in cols])
    desc = Window.partitionBy(*PLAYER).orderBy(F.col("frame_id").desc())
    h = h.withColumn("_rd", F.row_number().over(desc)).where(F.col("_rd") <= max_len - 1)
    hist_len = h.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("hist_len"))
    smp = samples.select("id", *PLAYER, *[F.col(c).cast("double").alias(c) for c in cols]).join(
        hist_len, PLAYER, "left").withColumn("hist_len", F.coalesce(F.col("hist_len"), F.lit(0)))
    # rows: the query at pos max_len-1, history rows before it
    query = smp.select("id", *PLAYER, F.lit(max_len - 1).alias("pos"), *cols)
    hist = smp.select("id", *PLAYER).join(h, PLAYER).select(
        "id", *PLAYER, (F.lit(max_len - 1) - F.col("_rd")).alias("pos"), *cols)
    # zeros fill every position before the history; a player without history
    # has one zero row in its place, which the same range covers
    upper = F.lit(max_len - 2) - F.least(F.col("hist_len"), F.lit(max_len - 1))
    zero_rows = (smp.where(upper >= 0)
                 .select("id", *PLAYER, F.explode(F.sequence(F.lit(0), upper)).alias("pos"),
                         *[F.lit(0.0).alias(c) for c in cols]))
    return query.unionByName(hist).unionByName(zero_rows).withColumn("pos", F.col("pos").cast("int"))


def history_arrays(rows: DataFrame, cols: list[str], max_len: int = 100, target: str = "is_out") -> DataFrame:
    """Histories in array form (q5): each target row's ``id`` and ``query`` (its own values), with ``history``, the values
    of its player's last ``max_len - 1`` input rows, oldest first, and their number ``hist_len``.

    ``rows`` has input and target rows of the same players, told apart by ``target``.  A player's array is collected
    once, from rows ranked by frame, within the play's partition: one scan and one exchange, no join.  Nothing is padded
    here; ``functions.batches.pad_histories`` does that where a model takes its batch.
    """
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    whole = Window.partitionBy(*PLAYER)
    is_target = F.col(target) == 1
    ranked = rows.select("id", *PLAYER, "frame_id", is_target.alias("_t"), values.alias("_v")).withColumn(
        "_rd", F.row_number().over(Window.partitionBy(*PLAYER, "_t").orderBy(F.col("frame_id").desc())))
    step = F.when(~F.col("_t") & (F.col("_rd") <= max_len - 1), F.struct("frame_id", "_v"))
    got = ranked.withColumn("_h", F.collect_list(step).over(whole)).where("_t")
    history = F.transform(F.array_sort("_h"), lambda s: s["_v"])
    return got.select("id", *PLAYER, F.size("_h").alias("hist_len"), history.alias("history"), F.col("_v").alias("query"))


def graph_nodes(samples: DataFrame, cols: list[str]) -> DataFrame:
    """Per-frame player sets as a keyed node table (q6): (play, frame, player,
    features, position, target).  Frames are groups by key, not collected lists."""
    return samples.select(*PLAY, "frame_id", "nfl_id", F.array(*[F.col(c).cast("double") for c in cols])
                          .alias("features"), "x_input", "y_input", "x", "y")


def single_step(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each row as a length-1 sequence (q7)."""
    return df.withColumn("sequence", F.array(F.struct(
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("features"))))


def horizon_steps(requests: DataFrame, horizon: int = MAX_HORIZON) -> DataFrame:
    """Index of each requested frame among the player's requests, held at the
    last model step: ``min(k, horizon - 1)`` (w14)."""
    w = Window.partitionBy(*PLAYER).orderBy("frame_id")
    return requests.withColumn("step", F.least(F.row_number().over(w) - 1, F.lit(horizon - 1)).cast("int"))


def cumulative(df: DataFrame, cols: list[str], order: str = "step") -> DataFrame:
    """Running sums per player (w13): per-step deltas become a trajectory."""
    w = Window.partitionBy(*PLAYER).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"cum_{c}": F.sum(c).over(w) for c in cols})


def reconstruct(requests: DataFrame, steps: DataFrame, anchors: DataFrame | None = None,
                horizon: int = MAX_HORIZON) -> DataFrame:
    """Predicted positions keyed by request id (m7): the request's held step is
    joined to the model's cumulative offset at that step, added to the last
    unified position, clipped, mapped back to the play direction and clipped
    again.  ``steps``: (player, step, dx, dy) cumulative offsets; ``anchors``:
    (player, play_direction, last_x, last_y), or None when the step rows
    already carry those columns (one join instead of two)."""
    r = horizon_steps(requests, horizon)
    j = r.join(steps, [*PLAYER, "step"], "left")
    if anchors is not None:
        j = j.join(anchors, PLAYER, "left")
    xu = clip(F.col("last_x") + F.col("dx"), 0.0, FIELD_LENGTH)
    yu = clip(F.col("last_y") + F.col("dy"), 0.0, FIELD_WIDTH)
    right = direction.is_right()
    x = F.when(right, FIELD_LENGTH - xu).otherwise(xu)
    y = F.when(right, FIELD_WIDTH - yu).otherwise(yu)
    return j.select("id", *PLAY, "nfl_id", "frame_id", "step",
                    clip(x, 0.0, FIELD_LENGTH).alias("x"), clip(y, 0.0, FIELD_WIDTH).alias("y"))
