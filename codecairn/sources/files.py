"""File sources: source trees, markdown folders, graph YAML."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.functions.text import (
    content_hash,
    normalize_newlines,
    parent_dir,
    suffix,
)
from codecairn.session import materialize, shuffle_width

# Language per registered file extension.
LANGUAGES = {".py": "python"}


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell pattern; ``*`` also crosses ``/``."""
    return "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def hidden(path: Column) -> Column:
    """Whether any component of a relative path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda part: F.startswith(part, F.lit(".")))


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    return reduce(
        lambda acc, p: acc | F.rlike(path, F.lit(glob_regex(p))), patterns, F.lit(False)
    )


def supported(path: Column) -> Column:
    return suffix(path).isin(*LANGUAGES)


def keep_path(path: Column, exclude: Sequence[str]) -> Column:
    """The three path predicates of a folder scan."""
    return ~hidden(path) & ~excluded(path, exclude) & supported(path)


def language(path: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), suffix(path))


def text_of(content: Column) -> Column:
    """Text of file bytes, newlines normalized; bytes that are not UTF-8 are replaced."""
    return normalize_newlines(F.make_valid_utf8(content.cast("string")))


def file_columns(files: DataFrame) -> DataFrame:
    """``(path, content)`` to the source file table; the hash is over the bytes."""
    return files.withColumn("source", text_of(F.col("content"))).select(
        "path",
        parent_dir(F.col("path")).alias("dir"),
        language(F.col("path")).alias("language"),
        "content",
        "source",
        F.length("source").alias("n_chars"),
        content_hash(F.col("content")).alias("source_hash"),
    )


# -- listing and reading -------------------------------------------------------
#
# Spark's own file readers leave out empty files and every name that starts
# with "_", so "__init__.py" would be lost.  Folders are therefore listed by a
# job per depth, all folders of a depth in parallel, a hot folder in slices.
# Files are packed into reading tasks by their bytes.  Any file system that
# Arrow knows can be read.

_ENTRY = "file string, path string, folder boolean, size long"


_PACKED = pa.schema(
    [("file", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("block", pa.int32()), ("bin", pa.int32())]
)
_ENTRY_ARROW = pa.schema(
    [("file", pa.string()), ("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())]
)


# Entries of a folder that are handed over at once.
SLICE = 10_000


def _entries(system: pafs.FileSystem, place: str) -> Iterator[tuple[str, str, bool, int]]:
    """Path, name, whether a folder, size; names that start with a dot and links to folders left out."""
    if isinstance(system, pafs.LocalFileSystem):  # read name by name, so that no list of all is held
        with os.scandir(place) as found:
            for e in found:
                folder = e.is_dir()
                if not e.name.startswith(".") and not (folder and e.is_symlink()):
                    yield e.path, e.name, folder, 0 if folder else e.stat().st_size
        return
    for info in system.get_file_info(pafs.FileSelector(place)):
        if not info.base_name.startswith("."):
            yield info.path, info.base_name, info.type == pafs.FileType.Directory, info.size or 0


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = pafs.FileSystem.from_uri(row["file"])
            scheme = row["file"].removesuffix(place)
            entries = _entries(system, place)
            while rows := [
                {"file": scheme + path, "path": f"{row['path']}/{name}" if row["path"] else name, "folder": folder, "size": size}
                for path, name, folder, size in islice(entries, SLICE)
            ]:
                yield pa.RecordBatch.from_pylist(rows, _ENTRY_ARROW)


def list_tree(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """``(file, path, size)`` of every file below a folder, hidden names left out."""
    width = shuffle_width(spark)
    level = spark.createDataFrame([(folder, prefix)], "file string, path string")
    found = []
    while True:
        listed = materialize(level.mapInArrow(_list_folders, _ENTRY))
        found.append(listed.where("not folder").select("file", "path", "size"))
        level = listed.where("folder").select("file", "path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = level.repartition(width, "file")


# Bytes one reading task takes on, and holds before it hands them over; what
# opening a file counts for; files that are packed together.
TASK_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
OPEN_BYTES = 4 << 10
BLOCK_FILES = 50_000


def first_fit(sizes: Sequence[int], limit: int) -> list[int]:
    """A bin for every size, the largest first, each into the first bin with room.

    A tree over the bins' free room finds that bin without a walk over all.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [limit] * (2 * leaves)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need, at = min(sizes[i], limit), 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        out[i] = at - leaves
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def pack_files(listed: DataFrame) -> DataFrame:
    """Add ``task``: files in bins of about even bytes, numbered from 0.

    Blocks of files are packed in parallel; only their numbers of bins reach
    the driver.  A file larger than a bin has one of its own.
    """
    spark = listed.sparkSession
    total = listed.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    limit = max(1, min(TASK_BYTES, -(-total.bytes // spark.sparkContext.defaultParallelism)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [row for batch in batches for row in batch.to_pylist()]
        bins = first_fit([row["size"] + OPEN_BYTES for row in rows], limit)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([row | {"block": part, "bin": b} for row, b in zip(rows, bins)], _PACKED)

    blocks = max(1, -(-total.files // BLOCK_FILES))
    columns = "file string, path string, size long"
    packed = materialize(
        listed.select("file", "path", "size").repartition(blocks).mapInArrow(pack, f"{columns}, block int, bin int")
    )
    first, starts = 0, []
    for r in packed.groupBy("block").agg(F.max("bin").alias("last")).orderBy("block").collect():
        starts.append((r.block, first))
        first += r.last + 1
    offset = spark.createDataFrame(starts, "block int, first int")
    return packed.join(F.broadcast(offset), "block").select("file", "path", "size", (F.col("first") + F.col("bin")).alias("task"))


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    rows, held = [], 0
    for batch in batches:
        for row in batch.select(["file", "path"]).to_pylist():
            system, place = pafs.FileSystem.from_uri(row["file"])
            with system.open_input_stream(place) as stream:
                rows.append({"path": row["path"], "content": stream.read()})
            held += len(rows[-1]["content"])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def read_contents(listed: DataFrame) -> DataFrame:
    """``(path, content)`` of listed files, one task for each of their bins."""
    packed = pack_files(listed)
    tasks = (packed.agg(F.max("task")).first()[0] or 0) + 1
    return packed.repartitionById(tasks, F.col("task")).mapInArrow(_read_contents, "path string, content binary")


def scan_tree(spark: SparkSession, folder: str, prefix: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """Source files below a folder of any file system; paths start with ``prefix``.

    The path predicates come before any content is read.
    """
    listed = list_tree(spark, folder, prefix).where(keep_path(F.col("path"), exclude))
    return file_columns(read_contents(listed))


def scan_files(
    spark: SparkSession, target: Path, repo_root: Path, exclude: Sequence[str] = ()
) -> DataFrame:
    """Source files below a folder, or one file, with paths relative to the root.

    A single file is taken as it is, whatever its name or folder.  For a
    folder the path predicates come before any content is read.
    """
    target, root = target.resolve(), repo_root.resolve()
    relative = target.relative_to(root).as_posix()
    if target.is_file():
        listed = spark.createDataFrame(
            [(str(target), relative, target.stat().st_size)], "file string, path string, size long"
        ).where(supported(F.col("path")))
    else:
        return scan_tree(spark, str(target), "" if relative == "." else relative, exclude)
    return file_columns(read_contents(listed))


def scan_roots(
    spark: SparkSession, targets: Sequence[Path], repo_root: Path, exclude: Sequence[str] = ()
) -> DataFrame:
    """Union of several roots; overlapping roots repeat their files."""
    scans = [scan_files(spark, t, repo_root, exclude) for t in targets]
    return reduce(DataFrame.unionByName, scans)


def filter_files(files: DataFrame, needle: str, repo_root: Path) -> DataFrame:
    """Files whose absolute path contains ``needle``."""
    absolute = F.concat(F.lit(str(repo_root.resolve()) + "/"), F.col("path"))
    return files.where(F.contains(absolute, F.lit(needle)))


def _read_texts(spark: SparkSession, folder: Path | str, ending: str) -> DataFrame:
    listed = list_tree(spark, str(folder.resolve()) if isinstance(folder, Path) else folder)
    read = read_contents(listed.where(F.endswith("path", F.lit(ending))))
    return read.select("path", text_of(F.col("content")).alias("text"))


def read_markdown(spark: SparkSession, folder: Path | str, doc_type: str) -> DataFrame:
    """``(doc_type, path, text)`` of every markdown file below a folder."""
    return _read_texts(spark, folder, ".md").select(
        F.lit(doc_type).alias("doc_type"), "path", "text"
    )


_GRAPH = (
    "path string, source_hash string, "
    "functions array<struct<name:string,scope:string,calls:array<struct<name:string,resolved:string>>>>"
)


def read_graph_yaml(spark: SparkSession, folder: Path) -> DataFrame:
    """Per-file graph YAML; files that do not parse or lack ``path`` are skipped."""
    def parse(batches):
        for batch in batches:
            rows = []
            for value in batch["text"]:
                try:
                    data = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                if not isinstance(data, dict) or "path" not in data:
                    continue
                fns = [
                    {
                        "name": f["name"],
                        "scope": f.get("scope"),
                        "calls": [
                            {"name": c["name"], "resolved": c.get("resolved")}
                            for c in f.get("calls", [])
                        ],
                    }
                    for f in data.get("functions", [])
                ]
                rows.append((data["path"], data.get("source_hash", ""), fns))
            yield pd.DataFrame(rows, columns=["path", "source_hash", "functions"])

    return _read_texts(spark, folder, ".yaml").mapInPandas(parse, _GRAPH)
