"""Vector scoring.

Scores are computed in Arrow batches: one matrix-vector product per batch is
several times cheaper than evaluating a lambda per dimension in the JVM (see
README, "Measured choices").
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrow list<float> batch, each list of ``width`` numbers, as a float64 matrix."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    wrong = lengths[lengths != width]
    if len(wrong):
        raise ValueError(f"index has a vector of {int(wrong[0])} dimensions, the query has {width}")
    values = vectors.flatten()
    if values.null_count:
        raise ValueError("index has a vector with a missing number")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of each vector with one query; 0 when either norm is 0, null for a null vector."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        scores = np.zeros(len(vectors))
        m = _matrix(vectors.drop_null(), q.shape[0])
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        norms[norms == 0.0] = 1.0
        scores[present] = (m @ q) / norms
        return pa.array(scores, pa.float64(), mask=~present)

    return score(vector)


def l2_norm(vector: Column) -> Column:
    """Euclidean norm in the JVM, as double."""
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
