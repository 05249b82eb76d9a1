"""Order-dependent budgets over directories, without gathering a directory.

Both folds below look sequential over the files of one directory.  A
directory may hold a large share of all files, so neither is run over a
collected group; each is cut into a distributed part that shrinks the input
and a small exact finish.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.functions.text import path_key
from codecairn.session import keyed, materialize, shuffle_width

# Characters of sibling files shown with a file, of source in
# one module batch, of source in a single-pass synthesis.
NEIGHBOR_CHARS = 50_000
MODULE_CHARS = 300_000
SINGLE_PASS_CHARS = 400_000


def directory_totals(files: DataFrame) -> DataFrame:
    """Files and characters per directory, counted before the shuffle."""
    return files.groupBy("dir").agg(
        F.count("*").alias("n_files"), F.sum("n_chars").cast("long").alias("n_chars")
    )


def total_chars(files: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long")
    return files.agg(
        total.alias("total_chars"), (total > SINGLE_PASS_CHARS).alias("needs_batching")
    )


# -- sibling files within a budget ------------------------------------------
#
# A file shows the siblings a greedy walk in path order keeps: each sibling
# that still fits.  If a sibling is kept, so was every earlier one that is no
# longer than it.  Hence a file can be kept for anyone only if the earlier
# files no longer than itself, and itself, add up to at most twice the budget
# (once for the walk, once more because one file is left out of its own walk).
# Each task throws away the files of its own partition that break this rule;
# what is left per directory is limited by the budget, not by the directory.
# Walks differ only for the files the full walk keeps, so one shared set per
# directory and one set per kept file give the result for every file.


def _candidates(budget: int):
    reach = 2 * budget

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directory, shortest_cut, kept = None, 0, np.empty(0, dtype=np.int64)
        for batch in batches:
            take = np.zeros(len(batch), dtype=bool)
            dirs = batch["dir"].to_numpy()
            sizes = batch["n_chars"].to_numpy()
            for i in range(len(batch)):
                if dirs[i] != directory:
                    directory, shortest_cut, kept = dirs[i], reach + 1, np.empty(0, np.int64)
                size = sizes[i]
                if size >= shortest_cut:
                    continue
                if kept[kept <= size].sum() + size > reach:
                    shortest_cut = size
                    continue
                kept = np.append(kept, size)
                take[i] = True
            yield batch[take]

    return run


def _walk(sizes: np.ndarray, budget: int, skip: int | None) -> list[int]:
    used, kept = 0, []
    for i, size in enumerate(sizes):
        if i != skip and used + size <= budget:
            used += size
            kept.append(i)
    return kept


def _keep_candidates(files: DataFrame, budget: int) -> DataFrame:
    return (
        files.withColumn("_key", path_key(F.col("path")))
        .sortWithinPartitions("dir", "_key")
        .drop("_key")
        .mapInPandas(_candidates(budget), files.schema)
    )


def neighbor_sets(
    files: DataFrame, budget: int = NEIGHBOR_CHARS, salts: int | None = None
) -> DataFrame:
    """``(dir, for_path, n_neighbors, neighbor_chars, neighbors)`` of non-empty siblings.

    ``for_path`` is null for the set shared by every file of the directory,
    or names the one file whose own walk differs.  Empty siblings always fit
    and are counted instead of being listed.

    Every task reduces its own files first, without a shuffle.  Where many
    tasks may share a directory, what they kept is reduced again in ``salts``
    parts per directory before the parts meet.
    """
    slim = files.where((F.col("n_chars") > 0) & (F.col("n_chars") <= budget)).select(
        "dir", "path", F.col("n_chars").cast("long").alias("n_chars")
    )
    local = _keep_candidates(slim, budget)
    salts = salts or shuffle_width(files.sparkSession) // 16
    if salts > 1:
        salt = F.pmod(F.xxhash64("path"), F.lit(salts))
        local = _keep_candidates(local.repartition("dir", salt), budget)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(group)), key=lambda i: group["path"].iloc[i].split("/"))
        sizes = group["n_chars"].to_numpy()[order]
        paths = group["path"].to_numpy()[order]
        shared = _walk(sizes, budget, None)
        rows = []
        for owner in [None, *shared]:
            kept = shared if owner is None else _walk(sizes, budget, owner)
            rows.append(
                (
                    group["dir"].iloc[0],
                    None if owner is None else paths[owner],
                    len(kept),
                    int(sizes[kept].sum()),
                    [paths[i] for i in kept],
                )
            )
        return pd.DataFrame(rows, columns=_SET_COLUMNS)

    return local.groupBy("dir").applyInPandas(
        finish,
        "dir string, for_path string, n_neighbors long, neighbor_chars long, neighbors array<string>",
    )


_SET_COLUMNS = ["dir", "for_path", "n_neighbors", "neighbor_chars", "neighbors"]


def join_neighbor_sets(
    files: DataFrame, sets: DataFrame, value: Column, empty_files: DataFrame
) -> DataFrame:
    """Add ``value`` of each file's own set, or of its directory's shared set, as
    ``neighbor_set``, and the number of its empty siblings as ``empty_neighbors``.

    Everything a directory shares is put into one row before it meets the
    files, so there is a single join on the directory; as its result is not
    needed in that layout, a hot directory is split at run time.
    """
    own = sets.where(F.col("for_path").isNotNull()).select(
        "dir", F.col("for_path").alias("path"), value.alias("_own")
    )
    shared = sets.where(F.col("for_path").isNull()).select("dir", value.alias("_shared"))
    empty = empty_files.groupBy("dir").agg(F.count("*").alias("_empty"))
    itself = F.when(F.col("n_chars") == 0, 1).otherwise(0)
    return (
        files.join(keyed(own), ["dir", "path"], "left")
        .join(keyed(shared.join(empty, "dir", "full_outer")), "dir", "left")
        .withColumn("neighbor_set", F.coalesce("_own", "_shared"))
        .withColumn("empty_neighbors", F.coalesce("_empty", F.lit(0)) - itself)
        .drop("_own", "_shared", "_empty")
    )


def neighbor_summary(files: DataFrame, budget: int = NEIGHBOR_CHARS) -> DataFrame:
    """Per file: number, characters and list of its (non-empty) neighbours."""
    slim = files.select("dir", "path", "n_chars")
    columns = F.struct("n_neighbors", "neighbor_chars", "neighbors")
    found = F.col("neighbor_set")
    empty = slim.where(F.col("n_chars") == 0)
    return join_neighbor_sets(slim, neighbor_sets(slim, budget), columns, empty).select(
        "dir",
        "path",
        (F.coalesce(found.n_neighbors, F.lit(0)) + F.col("empty_neighbors")).alias("n_neighbors"),
        F.coalesce(found.neighbor_chars, F.lit(0)).cast("long").alias("neighbor_chars"),
        F.coalesce(found.neighbors, F.array().cast("array<string>")).alias("neighbors"),
        "empty_neighbors",
    )


# -- module batches ----------------------------------------------------------
#
# Files of a directory are packed in path order; a batch closes before the
# file that would take it over the limit.  The files are cut into range blocks.
# For the first and last directory of a block (the only ones that can reach
# into another block) the block's effect on an open batch is worked out for
# every possible fill at its start: a step function with few steps, since
# packings that start at different files soon fall into step.  Chaining these
# functions over the blocks gives each block its true start, and a second pass
# over the same blocks numbers the batches.


def _block_steps(lengths: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (fill_from, fill_to, base, fill_kept, cuts) of one block.

    An open batch holding ``fill`` characters (from..to inclusive) leaves the
    block with ``base + fill`` if ``fill_kept`` else ``base``, after ``cuts`` cuts.
    """
    total = np.cumsum(lengths)
    before = total - lengths
    n = len(lengths)
    nxt = np.maximum(np.searchsorted(total, limit + before, side="right"), np.arange(n) + 1)
    left, cuts = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        left[i], cuts[i] = (left[j], cuts[j] + 1) if j < n else (total[-1] - before[i], 0)
    rows = []
    if total[-1] <= limit:
        rows.append((0, int(limit - total[-1]), int(total[-1]), 1, 0))
    # the first cut falls before file i for fills in (limit - total[i], limit - before[i]]
    for i in range(n):
        if before[i] > limit:
            break
        low, high = max(int(limit - total[i]) + 1, 0), int(limit - before[i])
        if i == 0:
            high = np.iinfo(np.int64).max
        if low > high:
            continue
        row = (low, int(high), int(left[i]), 0, int(cuts[i]) + 1)
        if rows and not rows[-1][3] and rows[-1][2:] == row[2:] and rows[-1][0] == high + 1:
            row = (low, rows.pop()[1], *row[2:])
        rows.append(row)
    # from an empty start (fill -1): the batch opens at the first file
    rows.append((-1, -1, int(left[0]), 0, int(cuts[0])))
    return rows


def _per_directory(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame, bool]]:
    """Directories of an ordered block, each whole, with a flag on the last."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for directory, rows in batch.groupby("dir", sort=False):
            if held and held[0]["dir"].iloc[0] != directory:
                yield held[0]["dir"].iloc[0], pd.concat(held), False
                held = []
            held.append(rows)
    if held:
        yield held[0]["dir"].iloc[0], pd.concat(held), True


def module_batches(files: DataFrame, limit: int = MODULE_CHARS) -> DataFrame:
    """``(dir, path, n_chars, batch)`` with the 0-based batch of every file.

    Only paths and lengths are shuffled.  The block layout is checkpointed,
    because both passes must see the same blocks even after a lost executor.
    """
    blocks = materialize(
        files.select(
            "dir",
            "path",
            F.col("n_chars").cast("long").alias("n_chars"),
            path_key(F.col("path")).alias("_key"),
        )
        .repartitionByRange(shuffle_width(files.sparkSession), "dir", "_key")
        .sortWithinPartitions("dir", "_key")
        .drop("_key")
        .withColumn("block", F.spark_partition_id())
    )

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for directory, rows, last in _per_directory(batches):
            if first or last:
                steps = _block_steps(rows["n_chars"].to_numpy(), limit)
                out = pd.DataFrame(steps, columns=["low", "high", "base", "kept", "cuts"])
                out.insert(0, "block", rows["block"].iloc[0])
                out.insert(0, "dir", directory)
                yield out
            first = False

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        fill, batch, rows = -1, 0, []
        for block, steps in group.groupby("block", sort=True):
            rows.append((group["dir"].iloc[0], block, fill, batch))
            hit = steps[(steps["low"] <= fill) & (fill <= steps["high"])].iloc[0]
            fill = int(hit["base"]) + (fill if hit["kept"] else 0)
            batch += int(hit["cuts"])
        return pd.DataFrame(rows, columns=["dir", "block", "fill", "first_batch"])

    starts = (
        blocks.mapInPandas(
            edges, "dir string, block int, low long, high long, base long, kept int, cuts long"
        )
        .groupBy("dir")
        .applyInPandas(chain, "dir string, block int, fill long, first_batch long")
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows, _ in _per_directory(batches):
            fill, batch = int(rows["fill"].iloc[0]), int(rows["first_batch"].iloc[0])
            out = np.empty(len(rows), dtype=np.int64)
            for i, size in enumerate(rows["n_chars"].to_numpy()):
                if fill >= 0 and fill + size > limit:
                    fill, batch = 0, batch + 1
                fill = max(fill, 0) + int(size)
                out[i] = batch
            yield rows[["dir", "path", "n_chars"]].assign(batch=out)

    # at most two directories per block need a start, so the side is tiny
    placed = blocks.join(F.broadcast(starts), ["dir", "block"], "left").select(
        "dir",
        "path",
        "n_chars",
        F.coalesce("fill", F.lit(-1)).alias("fill"),
        F.coalesce("first_batch", F.lit(0)).alias("first_batch"),
    )
    return placed.mapInPandas(number, "dir string, path string, n_chars long, batch long")
