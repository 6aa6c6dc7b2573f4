"""Scoring metric and error statistics (a9-a12, j7, v10).

The metric is one equi-join on the id and one global aggregate, for submissions
that come from elsewhere.  Where truth and prediction are columns of the same
rows, ``compare_models`` and ``errors_of`` need no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.session import cut_lineage

# The target columns (pr7).
TARGET = ["x", "y"]


class MetricInputError(ValueError):
    """A required column is missing from the solution or the submission."""


def _check(solution: DataFrame, submission: DataFrame, id_col: str) -> None:
    wanted = {id_col, *TARGET}
    lacking = {side: sorted(wanted - set(df.columns)) for side, df in (("truth", solution), ("prediction", submission))}
    if any(lacking.values()):
        raise MetricInputError("; ".join(f"{side} lacks {', '.join(cols)}" for side, cols in lacking.items() if cols))


def paired(solution: DataFrame, submission: DataFrame, id_col: str = "id") -> DataFrame:
    """Inner join on the id alone with ``_true`` / ``_pred`` suffixes (j7), whatever other columns the sides carry."""
    _check(solution, submission, id_col)
    sol = solution.select(id_col, *[F.col(c).alias(f"{c}_true") for c in TARGET])
    sub = submission.select(id_col, *[F.col(c).alias(f"{c}_pred") for c in TARGET])
    return sol.join(sub, id_col, "inner")


def rmse_report(solution: DataFrame, submission: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: rmse = sqrt(0.5 * (mse_x + mse_y)), per-axis RMSE and pair count (a9, a10)."""
    p = paired(solution, submission, id_col)
    mse_x = F.avg((F.col("x_true") - F.col("x_pred")) ** 2)
    mse_y = F.avg((F.col("y_true") - F.col("y_pred")) ** 2)
    return p.agg(
        F.sqrt(0.5 * (mse_x + mse_y)).alias("rmse"),
        F.sqrt(mse_x).alias("rmse_x"),
        F.sqrt(mse_y).alias("rmse_y"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def compare_models(rows: DataFrame, models: dict[str, tuple[F.Column, F.Column]], x: str = "x", y: str = "y") -> DataFrame:
    """One row per model: RMSE, per-axis RMSE and predicted rows, of predictions that are columns of the truth's rows.

    One aggregate over ``rows`` for all models; a row without a prediction is left out of that model's means.
    """
    sums = []
    for name, (px, py) in models.items():
        sums += [F.avg((F.col(x) - px) ** 2).alias(f"{name}_x"), F.avg((F.col(y) - py) ** 2).alias(f"{name}_y"), F.count(px).alias(f"{name}_n")]
    per = [F.struct(F.lit(name).alias("model"), F.sqrt(0.5 * (F.col(f"{name}_x") + F.col(f"{name}_y"))).alias("rmse"),
                    F.sqrt(f"{name}_x").alias("rmse_x"), F.sqrt(f"{name}_y").alias("rmse_y"), F.col(f"{name}_n").alias("n")) for name in models]
    return rows.agg(*sums).select(F.inline(F.array(*per)))


def score(solution: DataFrame, submission: DataFrame, row_id_column_name: str = "id") -> float:
    """The metric as a float (the one driver-side action of this module)."""
    return float(rmse_report(solution, submission, row_id_column_name).first()["rmse"])


def errors(pred: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    """Signed x/y error and distance error per paired row."""
    p = paired(truth, pred, id_col)
    ex = F.col("x_pred") - F.col("x_true")
    ey = F.col("y_pred") - F.col("y_true")
    return p.select(id_col, ex.alias("error_x"), ey.alias("error_y"),
                    F.sqrt(ex ** 2 + ey ** 2).alias("error_dist"))


def errors_of(rows: DataFrame, px: F.Column, py: F.Column, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """``errors`` of predictions that are columns of the truth's rows: a projection, no join."""
    ex, ey = px - F.col(x), py - F.col(y)
    return rows.select(id_col, ex.alias("error_x"), ey.alias("error_y"), F.sqrt(ex ** 2 + ey ** 2).alias("error_dist"))


def error_stats(err: DataFrame) -> DataFrame:
    """Mean and population std of each error column (a11), one row per error
    kind: one aggregate pass, then the single result row is unpivoted."""
    names = ("error_x", "error_y", "error_dist")
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"), F.count(n).alias(f"{n}_n")]
    row = err.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("error"), F.col(f"{n}_mean").alias("mean"),
                              F.col(f"{n}_std").alias("std"), F.col(f"{n}_n").alias("n")) for n in names])
    return row.select(F.inline(rows))


def error_histogram(err: DataFrame, column: str = "error_dist", bins: int = 50) -> DataFrame:
    """Counts over ``bins`` equal-width bins between min and max, top edge closed (a12).

    The column alone is written to the checkpoint folder, so that what made it runs once.  The range is one global
    aggregate (exactly one row); its two numbers are read and used as literal bin edges, as a bucketizer would, so the
    binning is a map-side projection followed by a partial aggregate, no join.  A zero-width
    range widens to +-0.5 around the value, as a histogram routine would.
    """
    err = cut_lineage(err.select(column))
    rng = err.agg(F.min(column).alias("lo0"), F.max(column).alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    r = rng.first()
    if r["lo"] is None:  # no values: no bins
        return err.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    lo, hi = F.lit(float(r["lo"])), F.lit(float(r["hi"]))
    binned = err.where(F.col(column).isNotNull()).select(
        F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins)).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return counts.select("bin", (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
                         (lo + F.col("bin") * width).alias("bin_hi"), "n")
