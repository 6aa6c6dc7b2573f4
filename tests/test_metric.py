"""Metric goldens (the only golden values of the reference) and error cases."""

import pytest

from trackframe.operators import metrics

SOLUTION = [("21_12_2_1", 1.0, 4.0), ("21_12_2_2", 2.0, 2.0), ("21_12_2_3", 3.0, 3.0)]


@pytest.mark.parametrize("xs, ys, expected", [
    ([1.1, 2, 3], [4, 2.2, 3], 0.0913),
    ([0, 2, 3], [4, 2.2, 3], 0.4163),
    ([1, 2, 1], [4, 0, 3], 1.1547),
])
def test_goldens(spark, xs, ys, expected):
    sol = spark.createDataFrame(SOLUTION, "id string, x double, y double")
    sub = spark.createDataFrame([(i, float(x), float(y)) for (i, _, _), x, y in zip(SOLUTION, xs, ys)],
                                "id string, x double, y double")
    assert round(metrics.score(sol, sub, "id"), 4) == expected


@pytest.mark.parametrize("drop_from, column", [("solution", "id"), ("submission", "id"),
                                               ("solution", "x"), ("submission", "y")])
def test_missing_columns_raise(spark, drop_from, column):
    sol = spark.createDataFrame(SOLUTION, "id string, x double, y double")
    sub = spark.createDataFrame(SOLUTION, "id string, x double, y double")
    if drop_from == "solution":
        sol = sol.drop(column)
    else:
        sub = sub.drop(column)
    with pytest.raises(metrics.MetricInputError):
        metrics.score(sol, sub, "id")


def test_row_id_argument_is_honoured(spark):
    sol = spark.createDataFrame(SOLUTION, "rid string, x double, y double")
    sub = spark.createDataFrame(SOLUTION, "rid string, x double, y double")
    assert metrics.score(sol, sub, "rid") == 0.0
