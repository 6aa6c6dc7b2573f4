"""Tracking tables derived from the driver's ``events`` table (fixture F6).

660 consecutive events make one play (22 players; the first 440 events are
pre-pass input frames, the last 220 post-pass output frames) and 10 plays make
one game, so a play's size does not grow with the data: a play is a bounded
group at any scale.

Partitioning: the play key is computed from ``event_id`` alone, so the table is
hash-partitioned on (game_id, play_id) *before* the frame numbering windows.
With ``spark.sql.requireAllClusterKeysForCoPartition=false`` every later
window / aggregate / join on a superset of the play key reuses this single
exchange (see ``trackframe.session``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAY = ["game_id", "play_id"]
PLAYER = ["game_id", "play_id", "nfl_id"]
FRAME = ["game_id", "play_id", "frame_id"]

# Fixed values of the fixture: events per play, input events per play,
# players per play, plays per game, weeks per season.
EVENTS_PER_PLAY = 660
INPUT_EVENTS_PER_PLAY = 440
PLAYERS_PER_PLAY = 22
PLAYS_PER_GAME = 10
WEEKS = 18

TASK_ROWS = 150_000  # rows of the plays that one task holds, about

INPUT_COLUMNS = [
    "game_id", "play_id", "player_to_predict", "nfl_id", "frame_id", "play_direction",
    "absolute_yardline_number", "player_height", "player_weight", "player_position",
    "player_side", "player_role", "x", "y", "s", "a", "dir", "o", "num_frames_output",
    "ball_land_x", "ball_land_y", "week",
]
OUTPUT_COLUMNS = ["game_id", "play_id", "nfl_id", "frame_id", "x", "y", "week"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cluster_by_play(df: DataFrame, rows: int) -> DataFrame:
    """Hash-partition by the play key once; everything downstream keys on a superset.

    ``rows``: how many ``df`` has.  The sorts and windows downstream widen a row many times over, so partitions of
    so many shuffled bytes would be too large for a task: their number follows the rows, about ``TASK_ROWS`` in each
    (not far fewer: a task of the long feature chains spends seconds on generated code, however few rows it has).
    """
    if rows <= TASK_ROWS:
        return df.repartition(*PLAY)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *PLAY)


def plain_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output rows without frame numbers: a projection of the scan, no exchange (profiles need no more)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    e = ev.select(
        "event_id", "user_id",
        (F.col("user_id") % PLAYERS_PER_PLAY).alias("n"),
        F.floor(F.col("event_id") / EVENTS_PER_PLAY).cast("bigint").alias("p"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    n, p, v, eid, uid = (F.col(c) for c in ("n", "p", "v", "event_id", "user_id"))

    def scaled(expr, mod, div=100.0):
        return (expr % mod).cast("double") / div

    return e.select(
        "event_id",
        F.floor(p / PLAYS_PER_GAME).cast("bigint").alias("game_id"),
        (p % PLAYS_PER_GAME).alias("play_id"),
        n.alias("nfl_id"),
        F.when(eid % EVENTS_PER_PLAY >= INPUT_EVENTS_PER_PLAY, 1).otherwise(0).alias("is_out"),
        ((n == 1) | (n >= 14)).alias("player_to_predict"),
        F.when(p % 2 == 0, "left").otherwise("right").alias("play_direction"),
        (10 + (p * 31) % 100).cast("double").alias("absolute_yardline_number"),
        F.when(n == 20, F.lit("bad"))
        .otherwise(F.concat((5 + n % 2).cast("string"), F.lit("-"), (n % 12).cast("string")))
        .alias("player_height"),
        F.when(n == 21, F.lit(None).cast("double")).otherwise((180 + n * 7).cast("double"))
        .alias("player_weight"),
        F.when(n == 0, "QB").when(n <= 3, "WR").when(n <= 5, "TE").when(n <= 10, "RB")
        .when(n <= 14, "CB").when(n <= 16, "FS").otherwise("ILB").alias("player_position"),
        F.when(n < 11, "Offense").otherwise("Defense").alias("player_side"),
        F.when(n == 0, "Passer").when(n == 1, "Targeted Receiver")
        .when(n < 11, "Other Route Runner").otherwise("Defensive Coverage").alias("player_role"),
        scaled(v * 37 + eid * 11, 12000).alias("x"),
        scaled(v * 53 + uid * 29, 5330).alias("y"),
        scaled(v * 17, 1000).alias("s"),
        scaled(v * 13, 600).alias("a"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
        .otherwise(scaled(v * 91 + eid * 7, 36000)).alias("dir"),
        F.when(eid % 89 == 0, F.lit(None).cast("double"))
        .otherwise(scaled(v * 71 + eid * 3, 36000)).alias("o"),
        scaled(p * 3701, 12000).alias("ball_land_x"),
        scaled(p * 1709, 5330).alias("ball_land_y"),
    )


def tracking_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full fixture table: input and output frames, ``is_out`` tells them apart."""
    q = cluster_by_play(plain_frames(spark, sf_dir), read_table(spark, sf_dir, "events").count())
    by_side = Window.partitionBy(*PLAYER, "is_out").orderBy("event_id")
    by_player = Window.partitionBy(*PLAYER)
    return q.select(
        "*",
        F.row_number().over(by_side).cast("bigint").alias("frame_id"),
        F.sum("is_out").over(by_player).cast("bigint").alias("num_frames_output"),
        (1 + F.col("game_id") % WEEKS).cast("int").alias("week"),
    )


def split_tracking(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(F1 input, F2 output) from one tracking frame (a plan that reads both scans the source once for each)."""
    inp = t.where(F.col("is_out") == 0).select(*INPUT_COLUMNS)
    out = t.where(F.col("is_out") == 1).select(*OUTPUT_COLUMNS)
    return inp, out


def tracking_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split_tracking(tracking_from_events(spark, sf_dir))


def input_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pre-pass tracking rows, one per (game, play, player, frame)."""
    return tracking_tables(spark, sf_dir)[0]


def output_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post-pass target positions."""
    return tracking_tables(spark, sf_dir)[1]


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rows to predict (keys of F2 plus the ``id`` string)."""
    out = output_frames(spark, sf_dir)
    return out.select(*PLAYER, "frame_id", row_id().alias("id"))


def row_id(*cols: str) -> F.Column:
    """``game_play_player_frame`` row id (pr3)."""
    cols = cols or ("game_id", "play_id", "nfl_id", "frame_id")
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def play_key() -> F.Column:
    """``game_play`` string (pr4)."""
    return F.concat_ws("_", F.col("game_id").cast("string"), F.col("play_id").cast("string"))
