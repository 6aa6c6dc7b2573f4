"""What a model's batch needs in numpy, at the edge between Spark and the model."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need not have this package


def pad_histories(history, query, max_len: int = 100) -> np.ndarray:
    """[rows, max_len, features] of lists of histories and query rows: zeros, then the history, then the query last."""
    if not len(query):
        return np.zeros((0, max_len, 0))
    last = np.stack([np.asarray(q, float) for q in query])
    out = np.zeros((len(last), max_len, last.shape[1]))
    for k, steps in enumerate(history):
        if len(steps):
            out[k, max_len - 1 - len(steps):max_len - 1] = np.stack([np.asarray(s, float) for s in steps])
    out[:, max_len - 1] = last
    return out
