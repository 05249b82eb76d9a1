"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecairn.session import materialize, shuffle_width


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running numbers of rows that come sorted by their first column."""
    last, count = (None, False), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code = pd.factorize(batch.column(0).to_pandas(), use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        number = np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code))) + 1
        first, end = batch.column(0)[0].as_py(), batch.column(0)[-1].as_py()
        if (first, True) == last:
            number[: starts[1] if len(starts) > 1 else len(code)] += count
        last, count = (end, True), int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=[*batch.schema.names, "_number"])


def rank_within(rows: DataFrame, group: str, order: list[Column | str], name: str = "rank", width: int | None = None) -> DataFrame:
    """Add ``name``: the place of a row in its group, from 1, by ``order``.

    Rows are range-partitioned by group and order, so a large group lies in many
    tasks.  Each task numbers its rows as they come; a group that began in an
    earlier task is moved on by what those hold.  At most one such group starts
    in each task, so the table of offsets is no longer than there are tasks.
    """
    width = width or shuffle_width(rows.sparkSession)
    keyed = rows.select(F.col(group).alias("_group"), "*")
    placed = keyed.repartitionByRange(width, F.col("_group"), *order).sortWithinPartitions("_group", *order)
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()))
    numbered = placed.mapInArrow(_number, T.StructType([*placed.schema.fields, T.StructField("_number", T.LongType())]))
    held = numbered.groupBy("_group", "_part").agg(F.max("_number").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.withColumn("_before", before).where(F.col("_before") > 0).select(F.col("_group").alias("_of"), F.col("_part").alias("_in"), "_before")
    return numbered.join(
        F.broadcast(offsets), F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")), "left"
    ).select(*rows.columns, (F.col("_number") + F.coalesce("_before", F.lit(0))).alias(name))
