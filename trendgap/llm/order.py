"""Rows in ascending key order, dealt to tasks as key ranges ("buckets").

The bounds come from a bounded sample of the key column; they decide who does the work,
never the result. Equal keys are always in one bucket. Null keys come first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

ROWS_PER_BUCKET = 1024
MAX_BUCKETS = 100_000
SAMPLED_PER_BUCKET = 20


def bucket_bounds(frame: DataFrame, key: str, rows: int = ROWS_PER_BUCKET) -> np.ndarray:
    """Keys at which buckets begin, sorted; at most MAX_BUCKETS of them."""
    keys = frame.select(key).where(F.col(key).isNotNull())
    total = keys.count()
    buckets = min(MAX_BUCKETS, -(-total // rows))
    if buckets < 2:
        return np.zeros(0, np.int64)
    wanted = buckets * SAMPLED_PER_BUCKET
    picked = keys.sample(min(1.0, wanted / total), seed=7).toPandas()[key].to_numpy()
    return np.unique(np.quantile(picked, np.arange(1, buckets) / buckets).astype(np.int64))


def bucket_of(keys: np.ndarray, missing: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket number of each key: 0 where it is missing, else 1 and up."""
    return np.where(missing, 0, np.searchsorted(bounds, keys, side="right") + 1)
