"""Data profile of tracking tables (a2, a5-a8, s2-s4).

Each profile is a grouped aggregate with map-side partial aggregation, then a
tiny global aggregate; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.sources.tracking import PLAY, PLAYER


BUCKETS = 64


def counts(inp: DataFrame) -> DataFrame:
    """Distinct games, plays (a play id is unique only inside its game) and players (a5)."""
    return inp.agg(
        F.count_distinct("game_id").alias("games"),
        F.count_distinct("game_id", "play_id").alias("plays"),
        F.count_distinct("nfl_id").alias("players"),
        F.count(F.lit(1)).alias("rows"),
    )


def distinct_plays(df: DataFrame) -> DataFrame:
    """Distinct (game_id, play_id) (a2)."""
    return df.select(*PLAY).distinct()


def plays_with_targets(t: DataFrame) -> DataFrame:
    """Distinct plays with training samples, from input and output rows in one table (a2): those with a player to predict
    that has rows of both kinds.  Rows shrink to players and plays before they are shuffled."""
    keyed = t.where(" AND ".join(f"{k} IS NOT NULL" for k in PLAYER))
    players = keyed.groupBy(*PLAYER).agg(F.bool_or(F.col("is_out") == 1).alias("out"), F.bool_or((F.col("is_out") == 0) & F.col("player_to_predict")).alias("wanted"))
    return players.where("out and wanted").select(*PLAY).distinct()


def value_counts(df: DataFrame, columns: list[str], k: int | None | dict[str, int | None] = 10) -> DataFrame:
    """The ``k`` most frequent values of each column (None: all; a dict gives each column's own, None where it has none),
    ties by the value's text (a6, s2).

    All columns are counted in one pass.  Where a column has a bound, its values are first ranked within buckets by hash,
    so that its task gets at most ``k`` values of each bucket, however many there are.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pair.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    limits = {c: v for c, v in (k if isinstance(k, dict) else dict.fromkeys(columns, k)).items() if v is not None}
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    top = counts
    if limits:
        bound = F.coalesce(*[F.when(F.col("column") == c, F.lit(v)) for c, v in limits.items()])
        bucket = F.when(bound.isNotNull(), F.pmod(F.xxhash64("value"), F.lit(BUCKETS))).otherwise(0)
        for extra in (["_bucket"], []):
            rank = F.row_number().over(Window.partitionBy("column", *extra).orderBy(*order))
            top = top.withColumns({"_bucket": bucket}).withColumn("rank", rank).where(bound.isNull() | (F.col("rank") <= bound))
    else:
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return top.select("column", "value", "n", F.col("rank").cast("int").alias("rank"))


def per_play_stats(inp: DataFrame, out: DataFrame) -> DataFrame:
    """Flagged input rows per play (the sum of ``player_to_predict`` over a
    play's rows), and output frames per player per play: mean, min, max of
    each (a7, a8).  Two-level aggregates."""
    flagged = inp.groupBy(*PLAY).agg(F.sum(F.col("player_to_predict").cast("int")).alias("v"))
    frames = out.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("v"))

    def stats(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("stat"), F.avg("v").alias("mean"),
                      F.min("v").cast("bigint").alias("min"), F.max("v").cast("bigint").alias("max"),
                      F.count(F.lit(1)).alias("groups"))

    return stats(flagged, "flagged_rows_per_play").unionByName(stats(frames, "frames_per_player_play"))


def plays_in_order(df: DataFrame, order_col: str) -> DataFrame:
    """Distinct plays in order of first appearance (s3): the first ``order_col``
    value per play, sorted by it (a distributed range sort, no global window)."""
    return df.groupBy(*PLAY).agg(F.min(order_col).alias("first_seen")).orderBy("first_seen")


def restrict_to_plays(df: DataFrame, plays: DataFrame) -> DataFrame:
    """Rows of the listed plays only (j6): a semi join on the play key."""
    return df.join(plays.select(*PLAY), PLAY, "left_semi")
