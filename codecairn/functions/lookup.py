"""Look-ups between string arrays of one row, in time proportional to their lengths.

Arrays and maps of the JVM are searched from end to end, so a look-up per
element is quadratic in the row; these use one dictionary per row.  Those
whose results lambdas read are marked non-deterministic, so that the optimizer
leaves them in a step of their own: inside a lambda a Python function cannot run.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())


@F.arrow_udf(_INTS)
def last_positions(wanted: pa.Array, keys: pa.Array) -> pa.Array:
    """Of each wanted string the last place among the keys, null where it is none of them."""
    made = []
    for row, row_keys in zip(wanted.to_pylist(), keys.to_pylist()):
        at = {key: i for i, key in enumerate(row_keys or ())}
        made.append([at.get(x) for x in row or ()])
    return pa.array(made, pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(_INTS))
def all_positions(wanted: pa.Array, keys: pa.Array) -> pa.Array:
    """Of each wanted string all places among the keys, in order; equal wanted strings share theirs."""
    made = []
    for row, row_keys in zip(wanted.to_pylist(), keys.to_pylist()):
        at: dict = {}
        for i, key in enumerate(row_keys or ()):
            at.setdefault(key, []).append(i)
        made.append([at.get(x, []) for x in row or ()])
    return pa.array(made, pa.list_(pa.list_(pa.int32())))


@F.arrow_udf(_INTS)
def running_starts(sizes: pa.Array) -> pa.Array:
    """Where each of several parts starts when they are laid end to end."""
    made = [list(accumulate(row[:-1], initial=0)) if row else [] for row in sizes.to_pylist()]
    return pa.array(made, pa.list_(pa.int32()))


last_positions, running_starts = (udf.asNondeterministic() for udf in (last_positions, running_starts))
