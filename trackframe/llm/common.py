"""Helpers shared by the operators: scratch tables, size-checked broadcasts, distributed ranks and id ranges."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    top = pathlib.Path(__file__).parents[2]
    bundle = f"{tempfile.mkdtemp(prefix='llm-code-')}/trackframe_code.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(pathlib.Path(__file__).parents[1].rglob("*.py")):
            z.write(f, f.relative_to(top))
    sc.addPyFile(bundle)
    sc._llm_shipped = True


def shipped(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``fn`` (spark, ...) behind ``ship``."""
    @functools.wraps(fn)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return fn(spark, *args)
    return run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="llm-scratch-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared scratch folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit into ``limit`` bytes, else ``df`` (a shuffle join follows)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def row_hash(df: DataFrame) -> Column:
    """A hash over every column, which breaks ties between rows with one id; rows that tie on it are copies."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def ranked(df: DataFrame, group: str, order: list[Column], out: str, tie: Column | None = None) -> DataFrame:
    """Add ``out``: the 0-based rank of a row within its ``group``, in the order of a hash of ``order``.

    The rows of a group are dealt over buckets by the hash's upper bits.  Counts by (group, bucket) give each bucket
    its first rank, and a row number within (group, bucket) the rest, so no task holds a whole group.  Rows of one order
    go by ``tie`` (a hash of all columns unless given).  The count table
    has at most groups x buckets rows, and the caller bounds the number of groups.  Nulls form a group of their own.
    """
    spark = df.sparkSession
    bits = max(8, min(16, (4 * partitions(spark) - 1).bit_length()))
    h = F.xxhash64(*order)
    keyed = df.withColumn("_rk_h", h).withColumn("_rk_b", F.shiftrightunsigned("_rk_h", 64 - bits).cast("int"))
    keyed = keyed.withColumn("_rk_g", F.coalesce(F.xxhash64(F.col(group).cast("string")), F.lit(0)))
    counts = keyed.groupBy("_rk_g", "_rk_b").agg(F.count("*").alias("_rk_n"))
    before = Window.partitionBy("_rk_g").orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_rk_g", "_rk_b", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_0"))
    within = Window.partitionBy("_rk_g", "_rk_b").orderBy("_rk_h", "_rk_t")
    rows = keyed.withColumn("_rk_t", row_hash(df) if tie is None else tie).withColumn("_rk_i", F.row_number().over(within) - 1)
    joined = rows.join(small(first, 24), ["_rk_g", "_rk_b"])
    return joined.withColumn(out, (F.col("_rk_0") + F.col("_rk_i")).cast("long")).drop(
        "_rk_g", "_rk_b", "_rk_h", "_rk_t", "_rk_i", "_rk_0")


def id_ranges(df: DataFrame, id_col: str, n: int, out: str) -> DataFrame:
    """Add ``out``: the number of the row's range when the numeric ids are cut at ``n`` approximate quantiles.

    The cuts are fixed numbers (at most ``n`` on the driver), so every later run deals the rows alike; null ids get a
    range of their own, the last.
    """
    accuracy = max(10_000, 20 * n)
    at = [i / n for i in range(1, n)]
    cuts = df.select(F.percentile_approx(F.col(id_col).cast("double"), at, accuracy).alias("c")).first()["c"] if at else []
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_ir_x", outputCol="_ir_b", handleInvalid="keep")
    bucketed = cut.transform(df.withColumn("_ir_x", F.coalesce(F.col(id_col).cast("double"), F.lit(float("nan")))))
    return bucketed.withColumn(out, F.col("_ir_b").cast("int")).drop("_ir_x", "_ir_b")


def without(docs: DataFrame, id_col: str, key: Column, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole.  ``decisions`` has one row per document: ``id``, ``key`` and ``kept``.

    ``key`` is a digest of the text, so that rows sharing an id (or with a null id) but not a text are told apart.
    Of rows with one id and key, of which some stay and some go (repeated rows), as many stay as were kept.  The
    dropped keys are broadcast only if their counted size allows; beyond that the join shuffles.
    """
    per = decisions.groupBy("id", "key").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    less = written(per.filter("k < n"), "less").select(F.col("id").alias("_wo_id"), F.col("key").alias("_wo_key"), F.col("k").alias("_wo_k"))
    keyed = docs.withColumn("_wo", key)
    on = F.col(f"`{id_col}`").eqNullSafe(F.col("_wo_id")) & F.col("_wo").eqNullSafe(F.col("_wo_key"))
    out = keyed.join(small(less.filter("_wo_k = 0"), 120), on, "left_anti")
    some = less.filter("_wo_k > 0")
    if not some.isEmpty():
        plain = out.join(small(some, 120), on, "left_anti")
        turn = Window.partitionBy("_wo_id", "_wo_key").orderBy("_wo_h")
        part = out.join(small(some, 120), on).withColumn("_wo_h", row_hash(docs))
        part = part.withColumn("_wo_i", F.row_number().over(turn)).filter("_wo_i <= _wo_k")
        out = plain.select(*docs.columns, "_wo").unionByName(part.select(*docs.columns, "_wo"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
