"""Structured Streaming versions of last-state and scoring (st1-st5).

Requests arrive as files, each holding whole plays (st1).  A stream over them
is processed by ``trigger(availableNow=True)`` with ``maxFilesPerTrigger`` so a
micro-batch holds some whole plays; the result does not depend on where the
batches are cut, which the tests check against the batch operators.

* ``stream_last_state`` keeps the last non-null value of every column per
  player (st3) as partial states, one table per micro-batch, merged by frame
  when read; nothing has to expire (st5), and no row can come too late.
* ``stream_score`` scores each micro-batch with ``foreachBatch`` (st2, st4):
  last state of the batch's plays, physics baseline, validation report and the
  ids seen, written under ``batch_id=N`` with overwrite, so a replayed batch
  replaces its own output (idempotent sink) and a repeated id is found.

All folders live under the session's checkpoint folder (shared storage on a
cluster); stream checkpoints make a restarted query resume where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trackframe.functions.nulls import last_non_null
from trackframe.operators import predict, quality, state
from trackframe.session import ensure_checkpoint_dir
from trackframe.sources.tracking import PLAY, PLAYER, row_id


BUCKET = "play_bucket"
FILE_ROWS = 250_000  # input rows of the plays of a request file, about
PIECE_ROWS = 50_000  # rows of a file of a table that is read by bucket, about
FEW_FILES = 8  # request files of a smaller input, if there are as many shuffle partitions


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def with_bucket(df: DataFrame, files: int) -> DataFrame:
    """``bucket``: the request file of the row's play, by a hash of the play key."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*PLAY), F.lit(files)).cast("int"))


def file_count(spark: SparkSession, rows: int) -> int:
    """Request files for plays of ``rows`` input rows: a micro-batch's size is bounded, and how many there are follows
    the rows, not the shuffle partitions (a batch's jobs cost seconds, however few rows it has)."""
    return max(min(FEW_FILES, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // FILE_ROWS))


def write_play_files(df: DataFrame, path: str, files: int, rows: int = 0, mode: str = "overwrite") -> str:
    """Request files for the stream (st1): every play lies whole in the folder of its bucket, in one file.  The number of
    buckets is ``files``, not the number of plays, and holds whatever partitions are coalesced, as the bucket is a
    partition column.  With ``rows`` (how many ``df`` has) a bucket is dealt by play to as many files as keep about
    ``PIECE_ROWS`` rows in each, for tables that are read by bucket: neither a writing nor a reading task holds a whole one."""
    pieces = max(1, -(-rows // (files * PIECE_ROWS)))
    piece = [F.pmod(F.xxhash64(F.lit(1), *PLAY), F.lit(pieces))] if pieces > 1 else []
    with_bucket(df, files).repartition(files * pieces, BUCKET, *piece).sortWithinPartitions(BUCKET, *PLAY).write.mode(mode) \
        .partitionBy(BUCKET).parquet(path)
    return path


def read_play_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Stream the request files, ``files_per_trigger`` files per micro-batch, with their bucket."""
    full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    return spark.readStream.schema(full).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_last_state(spark: SparkSession, inp: DataFrame, files_per_trigger: int = 2,
                      files: int | None = None, batches: list[int] | None = None) -> DataFrame:
    """Last non-null state per player over a stream of play files (st3, st5).

    Each micro-batch reduces its rows to one partial state per player (the last non-null value of every column with its
    frame) and writes it under its batch number; reading merges the partial states by frame.  Nothing is held between
    batches, so no state grows with the plays and no row can be late: any file order, any cut of a play into files and
    a replayed batch give the batch result.  ``batches``, if given, collects the batch numbers.
    """
    src = write_play_files(inp, scratch(spark, "stream-src"), files or file_count(spark, inp.count()))
    stream = read_play_stream(spark, src, inp.schema, files_per_trigger).drop(BUCKET)
    cols = [c for c in inp.columns if c not in PLAYER and c != "frame_id"]
    out = scratch(spark, "stream-last-state")
    done = batches if batches is not None else []

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial(batch, cols).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        done.append(batch_id)

    q = (stream.writeStream.option("checkpointLocation", scratch(spark, "stream-ckpt"))
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return merged(spark.read.parquet(out), inp.columns, cols)


def partial(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Per player: the last frame, and of each column the last non-null value with its frame."""
    keyed = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in PLAYER))
    at = [F.max(F.when(F.col(c).isNotNull(), F.col("frame_id"))).alias(f"_at_{c}") for c in cols]
    return keyed.groupBy(*PLAYER).agg(F.max("frame_id").alias("frame_id"), *[last_non_null(c).alias(c) for c in cols], *at)


def merged(parts: DataFrame, order: list[str], cols: list[str]) -> DataFrame:
    """Partial states merged by frame; one partial aggregate on the player."""
    values = [F.max_by(c, f"_at_{c}").alias(c) for c in cols]
    return parts.groupBy(*PLAYER).agg(F.max("frame_id").alias("frame_id"), *values).select(*order)


def score_batch(test_batch: DataFrame, inputs: DataFrame) -> DataFrame:
    """Physics predictions for one batch of plays (m10)."""
    plays = test_batch.select(*PLAY).distinct()
    batch_inputs = inputs.join(plays, PLAY, "left_semi")
    return predict.physics_baseline(state.scoring_samples(test_batch, batch_inputs))


REPEATED = "ids_of_earlier_batches"


def repeated_ids(spark: SparkSession, batch: DataFrame, store: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """One row (check, violations): how many ids of ``batch`` an earlier batch had (v10 across batches).

    The batch's ids are kept in ``store`` by batch number and bucket, so of all ids seen only those of the batch's own
    buckets are read, and a replayed batch neither meets itself nor writes twice.
    """
    batch.select("id", BUCKET).repartition("id", BUCKET).distinct().write.mode("overwrite").partitionBy(BUCKET).parquet(f"{store}/batch_id={batch_id}")
    own = F.col(BUCKET).isin(buckets)
    # the folders of other buckets are not even listed
    folders = [f"{store}/batch_id=*/{BUCKET}={b}" for b in buckets] or [store]
    seen = spark.read.option("basePath", store).schema(f"id string, batch_id long, {BUCKET} int").parquet(*folders).where(own)
    twice = seen.groupBy("id").agg(F.max((F.col("batch_id") == batch_id).cast("int")).alias("here"), F.min("batch_id").alias("first"))
    return twice.agg(F.count_if((F.col("here") == 1) & (F.col("first") < batch_id)).alias("violations")).select(F.lit(REPEATED).alias("check"), "violations")


def stream_score(spark: SparkSession, test: DataFrame, inp: DataFrame, files_per_trigger: int = 2,
                 files: int | None = None, root: str | None = None) -> DataFrame:
    """Score requests play batch by play batch with ``foreachBatch`` (st1, st2, st4)
    and return every batch's predictions read back from the sink."""
    root = root or scratch(spark, "stream-score")
    rows = inp.count()
    n = files or file_count(spark, rows)
    inputs_path = write_play_files(inp, f"{root}/inputs", n, rows)
    requests = test.select(*PLAYER, "frame_id", row_id().alias("id")) if "id" not in test.columns else test
    src = write_play_files(requests, f"{root}/requests", n)
    score_stream(spark, src, requests.schema, inputs_path, root, files_per_trigger)
    return spark.read.parquet(f"{root}/predictions")


def score_stream(spark: SparkSession, src: str, schema, inputs_path: str, root: str, files_per_trigger: int = 2) -> None:
    """Score the request files of ``src`` that no earlier run under ``root`` has scored: predictions, reports and the ids
    seen go below ``root`` by batch number."""
    inputs = spark.read.parquet(inputs_path)
    stream = read_play_stream(spark, src, schema, files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the batch's buckets (as many as it has files) are the only folders that are read
        own = [r[BUCKET] for r in batch.select(BUCKET).distinct().collect()]
        rows = batch.drop(BUCKET).repartition(*PLAY)
        # the written predictions feed the report: they are computed once
        scored = score_batch(rows, inputs.where(F.col(BUCKET).isin(own)).drop(BUCKET))
        scored.write.mode("overwrite").parquet(f"{root}/predictions/batch_id={batch_id}")
        pred = spark.read.schema(scored.schema).parquet(f"{root}/predictions/batch_id={batch_id}")
        report = quality.validate(pred, rows.select("id", *PLAY))
        report.unionByName(repeated_ids(spark, batch, f"{root}/ids", batch_id, own)).write.mode("overwrite").parquet(f"{root}/reports/batch_id={batch_id}")

    q = (stream.writeStream.option("checkpointLocation", f"{root}/ckpt")
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
