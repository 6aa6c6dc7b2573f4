"""Plays of an endless stream, given out when they end (st3, st5).

Frames come with an event time.  A play is a session of its player's frames: it ends when none has come for ``quiet`` of
event time, and once the watermark has passed that end the player's last state leaves the state store and is appended to
the sink, once, by the file sink's own log.  The state thus holds the plays under way, however long the stream runs.

A frame that comes after the watermark has passed its play's end is too late and left out, which ``delay`` bounds; where
frames may come in any order, ``streaming.scoring.stream_last_state`` keeps partial states instead.  A watermark moves
only with newer frames: a source that falls silent should send a heartbeat, a row with a null key and the present time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackframe.functions.nulls import last_non_null
from trackframe.sources.tracking import PLAYER

EVENT_TIME = "event_time"


def event_time(play_start: Column) -> Column:
    """A frame's time: 0.1 s a frame after the play's start (seconds)."""
    return F.timestamp_micros((play_start * 1_000_000 + F.col("frame_id") * 100_000).cast("bigint"))


def ended_plays(frames: DataFrame, cols: list[str], quiet: str = "5 seconds", delay: str = "1 second") -> DataFrame:
    """Per player of each ended play: its last non-null values of ``cols``, the last frame and the number of frames."""
    # the condition reads the event time, so that it is not moved before the watermark, which heartbeats must reach
    played = F.when(F.col(EVENT_TIME).isNotNull(), F.expr(" AND ".join(f"{k} IS NOT NULL" for k in PLAYER)))
    on_time = frames.withWatermark(EVENT_TIME, delay).where(played)
    last = [last_non_null(c).alias(c) for c in cols]
    per = on_time.groupBy(F.session_window(EVENT_TIME, quiet), *PLAYER).agg(F.max("frame_id").alias("frame_id"), F.count(F.lit(1)).alias("frames"), *last)
    return per.select(*PLAYER, "frame_id", "frames", *cols)


def write_in_time(df: DataFrame, path: str, files: int) -> str:
    """``df`` with its event times, and one heartbeat after all of them, as files that a stream reads in order of time."""
    at = F.unix_micros(EVENT_TIME)
    first, last = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if first is None:
        df.write.mode("append").parquet(path)
        return path
    slot = F.least(F.floor((at - first) * files / (last - first + 1)), F.lit(files - 1))
    for k in range(files):
        df.where(slot == k).coalesce(1).write.mode("append").parquet(path)
    beat = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != EVENT_TIME]
    df.sparkSession.range(1).select(*beat, F.timestamp_micros(F.lit(last) + 86_400_000_000).alias(EVENT_TIME)).select(*df.columns).write.mode("append").parquet(path)
    return path


def run_ended_plays(spark: SparkSession, source: str, schema, cols: list[str], out: str, checkpoint: str, quiet: str = "5 seconds",
                    delay: str = "1 second", files_per_trigger: int = 1) -> StreamingQuery:
    """Stream the files of ``source`` and append every play to ``out`` when it has ended; the query, after all files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = (ended_plays(stream, cols, quiet, delay).writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
