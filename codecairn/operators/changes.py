"""What changed in source files: lines that came and went, per file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecairn.functions.diff import hunks, line_changes

_CHANGES = pa.schema(
    [("path", pa.string()), ("status", pa.string()), ("added", pa.int64()), ("removed", pa.int64()), ("hunks", pa.string())]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            old, new = ([] if t is None else t.split("\n") for t in (row["old"], row["new"]))
            gone, come = line_changes(old, new)
            rows.append(
                {"path": row["path"], "status": row["status"], "added": len(come), "removed": len(gone), "hunks": hunks(old, new, gone, come)}
            )
        yield pa.RecordBatch.from_pylist(rows, _CHANGES)


def file_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, status, added, removed, hunks)`` of files that differ.

    Both sides hold ``path``, ``source_hash`` and ``source``, one row per path.
    Only paths and hashes are compared; the texts of changed files then join
    them and are compared line by line in the tasks.
    """
    was = stored.select("path", F.col("source_hash").alias("was"))
    now = current.select("path", F.col("source_hash").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    changed = was.join(now, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", status.alias("status"))
    old = stored.select("path", F.col("source").alias("old"))
    new = current.select("path", F.col("source").alias("new"))
    both = changed.join(old, "path", "left").join(new, "path", "left")
    return both.select("path", "status", "old", "new").mapInArrow(
        _compare, "path string, status string, added bigint, removed bigint, hunks string"
    )
