"""File sinks: one markdown or YAML file per row, for readers outside Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecairn.session import materialize

_DRAFTS = pa.schema([("draft", pa.string()), ("path", pa.string())])


def write_texts(texts: DataFrame, folder: str) -> int:
    """Write ``(path, text)`` rows as files below a folder; returns how many.

    In two phases: every attempt of a task writes below a hidden folder of its
    own, and what the attempts that Spark counts have written is then moved into
    place, file by file.  A lost executor leaves no half file, and a failed job
    none at all.  Moving twice does no harm, so that phase may be repeated too.
    Of rows with one path one stays.
    """
    job = f".writing-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = pafs.FileSystem.from_uri(folder)
        attempt = f"{root.rstrip('/')}/{job}/{task.partitionId()}-{task.taskAttemptId()}"
        made: set[str] = set()
        for batch in batches:
            rows = batch.to_pylist()
            drafts = []
            for row in rows:
                drafts.append(f"{attempt}/{len(made) // 1000}/{len(made)}")
                made.add(drafts[-1])
                system.create_dir(drafts[-1].rpartition("/")[0], recursive=True)
                with system.open_output_stream(drafts[-1], compression=None) as stream:
                    stream.write((row["text"] or "").encode())
            yield pa.RecordBatch.from_pydict({"draft": drafts, "path": [r["path"] for r in rows]}, _DRAFTS)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                place = f"{root.rstrip('/')}/{row['path']}"
                if system.get_file_info(row["draft"]).type == pafs.FileType.NotFound:
                    continue  # moved by an attempt before this one
                system.create_dir(place.rpartition("/")[0], recursive=True)
                system.move(row["draft"], place)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    written = materialize(texts.select("path", "text").mapInArrow(write, "draft string, path string"))
    chosen = written.groupBy("path").agg(F.max("draft").alias("draft")).select("draft", "path")
    moved = chosen.mapInArrow(move, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    system, root = _driver_system(folder)
    if system.get_file_info(f"{root}/{job}").type != pafs.FileType.NotFound:
        system.delete_dir(f"{root}/{job}")  # drafts of lost attempts and of repeated paths
    return moved


def _driver_system(folder: str) -> tuple[pafs.FileSystem, str]:
    system, root = pafs.FileSystem.from_uri(folder)
    return system, root.rstrip("/")


def graph_yaml(graphs: DataFrame) -> DataFrame:
    """``(path, text)``: the graph YAML of each file.

    ``graphs`` holds ``path``, ``source_hash``, ``imports`` and ``functions``.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data = {
                    "path": row["path"],
                    "source_hash": row["source_hash"],
                    "imports": [_without_nulls(i) for i in row["imports"]],
                    "functions": [_function(f) for f in row["functions"]],
                }
                text = yaml.safe_dump(data, default_flow_style=False, sort_keys=False)
                rows.append({"path": row["path"] + ".yaml", "text": text})
            yield pa.RecordBatch.from_pylist(rows, schema)

    wanted = graphs.select("path", "source_hash", "imports", "functions")
    return wanted.mapInArrow(render, "path string, text string")


def _without_nulls(row: dict) -> dict:
    return {k: v for k, v in row.items() if v is not None}


def _function(row: dict) -> dict:
    calls = [{"name": c["name"], "resolved": c["resolved"]} for c in row["calls"]]
    return _without_nulls({"name": row["name"], "scope": row["scope"], "calls": calls})
