"""Every registered query against its SQL oracle (DuckDB) on the smallest fixture."""

import numpy as np
import pytest

import __spark_entry__ as entry
from trackframe.plans.queries import REGISTRY
from helpers import duck, rows_of
from conftest import SF_MID, SF_SMALL
from trackframe.operators import modeling

QUERIES = {k: v for k, v in entry.queries().items() if k in REGISTRY}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    types = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert types == {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    got = df.toPandas()
    want = con.execute(ORACLE[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_tree_queries(spark):
    """Validation plays only, finite predictions nearer than zero; importances rank the features."""
    from pyspark.sql import functions as F
    pred = QUERIES["gbt_predict"](spark, SF_MID).toPandas()
    assert len(pred) and np.isfinite(pred[["pred_x", "pred_y"]].to_numpy()).all()
    samples = modeling.split_by_play(REGISTRY["training_samples"](spark, SF_MID))
    assert len(pred) == samples.where("is_val").count()
    error = ((pred["pred_x"] - pred["x"]) ** 2 + (pred["pred_y"] - pred["y"]) ** 2).mean()
    assert error < (pred["x"] ** 2 + pred["y"] ** 2).mean()
    ranked = QUERIES["feature_importance"](spark, SF_MID)
    values = [r["importance_avg"] for r in ranked.select(F.col("importance_avg")).collect()]
    assert 0 < len(values) <= 10 and values == sorted(values, reverse=True) and values[0] > 0


def test_only_model_fits_lack_an_oracle():
    assert ROWS_ONLY == ["feature_importance", "gbt_predict"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"id", "x", "y"}
