"""Last known state per player and sample building (a1, pr1-pr3, j1, j2).

All of it keys on the player key (game_id, play_id, nfl_id); on an input that
is hash-partitioned by the play key the aggregate and the join run without a
further exchange.  ``max_by`` is a partial aggregate, so even a hot key is
reduced map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.nulls import last_non_null
from trackframe.sources.tracking import PLAYER, row_id

STATE_COLUMNS = ["x", "y", "s", "a", "dir", "o"]


def last_state(df: DataFrame, keys: list[str] = PLAYER, order: str = "frame_id",
               drop: tuple[str, ...] = ()) -> DataFrame:
    """Last non-null value of every column per key, ordered by ``order`` (a1).

    Rows whose key has a null part are dropped, as a grouped aggregate in a
    tabular frame would (n11).  ``order`` itself is returned as its maximum.
    """
    value_cols = [c for c in df.columns if c not in keys and c not in drop]
    aggs = [
        (F.max(order) if c == order else last_non_null(c, order)).alias(c)
        for c in value_cols
    ]
    keyed = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return keyed.groupBy(*keys).agg(*aggs)


def as_input_state(last: DataFrame) -> DataFrame:
    """Suffix the motion columns with ``_input``; frame_id -> last_input_frame_id (pr1)."""
    mapping = {c: f"{c}_input" for c in STATE_COLUMNS if c in last.columns}
    if "frame_id" in last.columns:
        mapping["frame_id"] = "last_input_frame_id"
    return last.withColumnsRenamed(mapping)


def input_state(inp: DataFrame) -> DataFrame:
    """Last state of the pre-pass rows, renamed for joining to target rows."""
    return as_input_state(last_state(inp, drop=("week",)))


def training_samples(inp: DataFrame, out: DataFrame, include_all_players: bool = False) -> DataFrame:
    """Target rows left-joined with the last input state (j1, pr2, pr3).

    Keeping only flagged players turns the outer join into an inner one (n10),
    which Catalyst does by itself.
    """
    state = input_state(inp)
    samples = out.join(state, PLAYER, "left")
    if not include_all_players and "player_to_predict" in samples.columns:
        samples = samples.where(F.col("player_to_predict"))
    return samples.withColumn("id", row_id())


def scoring_samples(test: DataFrame, inp: DataFrame) -> DataFrame:
    """Rows to predict left-joined with the last input state (j2)."""
    return test.join(input_state(inp), PLAYER, "left")


def attach_input_state(t: DataFrame, is_out: str = "is_out", keep_input: bool = False) -> DataFrame:
    """Window form of last state + join for a table holding both input and
    output frames (rows with ``is_out = 0`` are pre-pass input).

    Each output row gets the last non-null pre-pass value of every attribute,
    the same values ``scoring_samples`` joins in, but computed by one window
    over the player key: no aggregate, no join, no second scan.  On a table
    partitioned by the play key the window adds no exchange.  With ``keep_input`` the
    input rows stay too, with their own values and ``is_out``.
    """
    w = Window.partitionBy(*PLAYER)
    pre = F.col(is_out) == 0
    attrs = [c for c in t.columns if c not in PLAYER and c not in (is_out, "frame_id", "x", "y",
                                                                   "event_id", "week")]
    cols = {}
    for c in attrs:
        name = f"{c}_input" if c in STATE_COLUMNS else c
        cols[name] = F.max_by(F.col(c), F.when(pre & F.col(c).isNotNull(), F.col("frame_id"))).over(w)
    for c in ("x", "y"):
        cols[f"{c}_input"] = F.max_by(F.col(c), F.when(pre & F.col(c).isNotNull(), F.col("frame_id"))).over(w)
    cols["last_input_frame_id"] = F.max(F.when(pre, F.col("frame_id"))).over(w)
    keep = [c for c in ("game_id", "play_id", "nfl_id", "frame_id", "x", "y", "week") if c in t.columns]
    if keep_input:
        own = {f"{c}_input": c for c in STATE_COLUMNS}
        cols = {n: c if n == "last_input_frame_id" else F.when(pre, F.col(own.get(n, n))).otherwise(c) for n, c in cols.items()}
        return t.withColumns(cols).select(*keep, is_out, *cols)
    return t.withColumns(cols).where(~pre).select(*keep, *cols)


def fused_training_samples(t: DataFrame, include_all_players: bool = False) -> DataFrame:
    """``training_samples`` over one tracking table with ``is_out``."""
    s = attach_input_state(t)
    if not include_all_players and "player_to_predict" in s.columns:
        s = s.where(F.col("player_to_predict"))
    return s.withColumn("id", row_id())
