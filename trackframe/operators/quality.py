"""Checks on a prediction table against the rows requested (v1-v11, u2, u3).

``validate`` returns one row per check, (check, violations), computed with
distributed aggregates and keyed joins; schema checks are answered from the
plan, without touching data.  ``assert_valid`` raises a named error class
for a failing report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from trackframe.sources.tracking import PLAY

EXPECTED_COLUMNS = ["x", "y"]


class InvalidSubmission(ValueError):
    """The prediction table breaks a check."""

    error_type = "INVALID_SUBMISSION"


def schema_problems(pred: DataFrame, id_col: str = "id") -> list[str]:
    """Column-set checks on the plan only (v4-v6, u3): the id must be present
    (rows are keyed), the value columns must be exactly x and y, numeric."""
    cols = pred.columns
    problems = []
    if id_col not in cols:
        problems.append(f"missing id column '{id_col}'")
    values = [c for c in cols if c not in (id_col, *PLAY, "nfl_id", "frame_id", "fallback", "step")]
    if sorted(set(values)) != sorted(EXPECTED_COLUMNS) or len(values) != len(EXPECTED_COLUMNS):
        problems.append(f"value columns must be {EXPECTED_COLUMNS}, got {values}")
    for f in pred.schema.fields:
        if f.name in EXPECTED_COLUMNS and not isinstance(f.dataType, NumericType):
            problems.append(f"column '{f.name}' must be numeric")
    return problems


def validate(pred: DataFrame, requested: DataFrame, id_col: str = "id") -> DataFrame:
    """(check, violations) for: null and non-finite values (v7, v8), rows per
    play against the request (v2), missing / extra / duplicate ids (v10) and an
    empty request (v3).  A schema problem (v1, v4-v6) is reported as one row
    per problem with violations 1."""
    spark: SparkSession = pred.sparkSession
    problems = schema_problems(pred, id_col)
    if problems:
        return spark.createDataFrame([(p, 1) for p in problems], "check string, violations bigint")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    keys = [k for k in PLAY if k in requested.columns]
    told = [k for k in keys if k in pred.columns]  # a prediction without its play takes the play of the request with its id
    # per (play, id): predicted rows, with null and non-finite counts; requested rows
    p_ids = pred.groupBy(*told, id_col).agg(
        F.count(F.lit(1)).alias("np"),
        F.count_if(x.isNull() | y.isNull()).alias("nnull"),
        F.count_if(F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf")))
        .alias("nbad"))
    r_ids = requested.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("nr"))
    ids = p_ids.join(r_ids, [*told, id_col], "full_outer")
    np_, nr_ = F.coalesce(F.col("np"), F.lit(0)), F.coalesce(F.col("nr"), F.lit(0))
    if keys:
        # per-play totals by a window on the play key (where the join was by it too, its output is
        # already partitioned by it), flagged once per play; an extra id without a play is in none
        play = Window.partitionBy(*keys)
        first = F.row_number().over(play.orderBy(id_col)) == 1
        placed = F.lit(True) if told == keys else F.col(keys[0]).isNotNull()
        wrong_play = placed & first & (F.sum(np_).over(play) != F.sum(nr_).over(play))
    else:
        wrong_play = F.lit(False)
    checks = ids.select("*", wrong_play.alias("_wrong")).agg(
        F.coalesce(F.sum("nnull"), F.lit(0)).alias("null_values"),
        F.coalesce(F.sum("nbad"), F.lit(0)).alias("non_finite_values"),
        F.count_if(F.col("np").isNull()).alias("missing_ids"),
        F.count_if(F.col("nr").isNull()).alias("extra_ids"),
        F.count_if(F.col("np") > 1).alias("duplicate_ids"),
        F.count_if(F.col("_wrong")).alias("plays_with_wrong_row_count"),
        (F.coalesce(F.sum("nr"), F.lit(0)) == 0).cast("bigint").alias("empty_request"),
    )
    names = ["null_values", "non_finite_values", "missing_ids", "extra_ids", "duplicate_ids",
             "plays_with_wrong_row_count", "empty_request"]
    # one pass; the single result row becomes (check, violations) rows
    return checks.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("violations")) for c in names])))


def assert_valid(report: DataFrame) -> None:
    """Raise ``InvalidSubmission`` naming every failed check (one small action)."""
    bad = [(r["check"], r["violations"]) for r in report.where(F.col("violations") > 0).collect()]
    if bad:
        raise InvalidSubmission("; ".join(f"{c}: {v}" for c, v in bad))


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Union of prediction batches by name (u2); differing column sets or
    types are an error rather than a silent widening."""
    if not batches:
        raise InvalidSubmission("no prediction batches")
    first = batches[0]
    for b in batches[1:]:
        if [(f.name, f.dataType) for f in b.schema.fields] != [(f.name, f.dataType) for f in first.schema.fields]:
            raise InvalidSubmission(f"batch schema {b.schema.simpleString()} != {first.schema.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b), batches)
