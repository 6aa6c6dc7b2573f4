"""Embedding whitening: blockwise QR of the centred rows, bidiagonal qd solver for singular values, twisted factorisations.

An entry c becomes the integer floor(256 c).  The fit list holds each distinct integer vector once: n of them, S their sum
by dimension.  Tasks centre their rows by S / n and keep only the triangle R of a QR over blocks of rows; the triangles
are stacked and reduced by QR again, ``FAN`` at a time, so that one of d x d remains whatever the rows.  R'R is n times
the covariance without ever having been formed, and ``qd_solver.leading`` solves it on the driver, whose work depends on
the dimension alone.  A pass over all rows projects them.

Only tables of one row for each partition or dimension reach the driver.  Copies of a vector, however many, meet as one
by the partial aggregation of ``distinct``.

Defined cases: a row whose vector is null or holds a null or non-finite entry is left out; so is one whose vector has
another length than most distinct vectors (of equally common lengths the longest counts), as no covariance joins them.
Entries beyond the range of a long are cut to it.  An empty table, or one without entries, gives an empty result.  A
component without variance (one distinct vector, fewer independent vectors than components) has ``whitened`` and
``explained`` 0 and counts fully in ``identity_error``.  There are as many components as dimensions if those are fewer.
``deviation`` is exact; where it exceeds a long, ``OverflowError`` is raised rather than a wrong number returned.  Repeated rows and null ids have results like
others.  Only the id and the vector are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from trackframe.llm.common import written
from trackframe.llm.qd_solver import leading

SCALE = 256
FAN = 16
BLOCK = 4096
EXACT = 1 << 62


def matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """The list column ``name``, whose lists all have ``d`` entries, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integer_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x of the rows whose vector is whole."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    rows = df.filter(whole).select(F.col(f"`{id_col}`").alias("id"), vec.alias("v"))
    return rows.select("id", F.transform("v", lambda c: F.floor(F.least(F.greatest(c, F.lit(-2.0 ** 54)), F.lit(2.0 ** 54)) * SCALE).cast("long")).alias("x"))


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch, "x", d)
            low, high = x & 0xFFFFFFFF, x >> 32  # halves, so that no sum of a batch overflows
            n += len(x)
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low.sum(axis=0), high.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total])], ["k", "n", "s"])
    parts = fit.select("x").mapInArrow(run, "k int, n long, s string")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return rows[0]["n"], [int(r["s"]) for r in rows]


def triangle(parts: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of a QR over blocks of rows, one after the other."""
    r = np.zeros((0, d))
    for part in parts:
        for at in range(0, len(part), BLOCK):
            r = np.linalg.qr(np.vstack([r, part[at:at + BLOCK]]), mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def reduced(fit: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: by partition, then in a tree."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((matrix(b, "x", d) - mean for b in batches), d)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def again(rows: pa.Table) -> pa.Table:
        r = triangle((np.frombuffer(b, float).reshape(d, d) for b in rows["r"].to_pylist()), d)
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})
    parts = written(fit.select("x").mapInArrow(first, "r binary"), "triangles")
    while (n := parts.count()) > FAN:
        dealt = parts.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(-(-n // FAN))))
        parts = written(dealt.groupBy("g").applyInArrow(lambda t: again(t), "r binary"), "triangles")
    return triangle((np.frombuffer(bytes(row["r"]), float).reshape(d, d) for row in parts.collect()), d)


def projections(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return (x - mean) @ directions.T


def identity_error(fit: DataFrame, d: int, mean: np.ndarray, directions: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened values."""
    k = len(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k + 1))
        for b in batches:
            w = projections(matrix(b, "x", d), mean, directions)
            out += np.c_[w.T @ w, w.sum(axis=0)]
        cells = [(i, j, float(out[i, j])) for i in range(k) for j in range(k + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells])], ["i", "j", "v"])
    got = np.zeros((k, k + 1))
    for row in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[row["i"], row["j"]] = row["v"] / n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """sum over dimensions of (n x - S) ** 2, exact."""
    far = max(abs(n) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, total)), 1)
    if far * far * x.shape[1] < EXACT:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1)
    wide = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
    if max(wide, default=0) >= 1 << 63:
        raise OverflowError("a deviation exceeds a long")
    return np.array(wide, np.int64)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = integer_rows(df, id_col, vec_col)
    fields = [StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
              StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())]
    schema = StructType([StructField("id", rows.schema["id"].dataType), *fields])
    fit = written(rows.select("x").distinct(), "fit")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or sizes["d"] == 0:
        return df.sparkSession.createDataFrame([], schema)
    d = sizes["d"]
    fit = fit.filter(F.size("x") == d)
    n, total = sums(fit, d)
    mean = np.array([s / n for s in total])  # the division of two integers rounds once
    r = reduced(fit, d, mean)
    values, vectors = leading(r, min(components, d))
    trace = float((r ** 2).sum())
    spread = np.sqrt(values / n)
    held = values > trace * d * np.finfo(float).eps ** 2 * d
    directions = np.where(held[:, None], vectors / np.where(held, spread, 1.0)[:, None], 0.0)
    explained = np.where(held, values / (trace or 1.0), 0.0)
    error = identity_error(fit, d, mean, directions, n)
    k = len(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, "x", d)
            m = len(x)
            cols = [b.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(deviations(x, n, total), k)), pa.array(projections(x, mean, directions).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)
    return rows.filter(F.size("x") == d).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
