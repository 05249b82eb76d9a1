"""Order-dependent budgets against the plain sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from codecairn.operators import budgets


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "dir string, path string, n_chars long").repartition(parts)


def in_order(rows):
    out = {}
    for d, p, n in sorted(rows, key=lambda r: r[1].split("/")):
        out.setdefault(d, []).append((p, n))
    return out


def brute_neighbors(rows, budget):
    out = {}
    for files in in_order(rows).values():
        for path, _ in files:
            used, kept = 0, []
            for other, n in files:
                if other != path and used + n <= budget:
                    used += n
                    kept.append((other, n))
            out[path] = (len(kept), used, [p for p, n in kept if n])
    return out


def brute_batches(rows, limit):
    out = {}
    for files in in_order(rows).values():
        batch, used, count = 0, 0, 0
        for path, n in files:
            if count and used + n > limit:
                batch, used, count = batch + 1, 0, 0
            used, count = used + n, count + 1
            out[path] = batch
    return out


def random_rows(rng, n_files, sizes, dirs=("hot", "b", "c")):
    rows = []
    for i in range(n_files):
        d = "hot" if rng.random() < 0.6 else rng.choice(dirs)
        rows.append((d, f"{d}/f{rng.randint(0, 9)}/m{i}.py", rng.choice(sizes)))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_neighbors_match_the_walk(spark, seed):
    rng = random.Random(seed)
    sizes = [[0, 5, 9, 40, 99, 100, 101], [1, 2, 3], [30, 60, 90, 150], [0, 0, 100], [7], list(range(1, 120))][seed]
    rows = random_rows(rng, 120, sizes)
    got = {
        r.path: (r.n_neighbors, r.neighbor_chars, r.neighbors)
        for r in budgets.neighbor_summary(frame(spark, rows), 100).collect()
    }
    assert got == brute_neighbors(rows, 100)
    salted = budgets.neighbor_sets(frame(spark, rows), 100, salts=3)
    plain = budgets.neighbor_sets(frame(spark, rows), 100)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


def test_neighbor_golden(spark):
    rows = [("d", f"d/{i}.py", n) for i, n in enumerate([1, 30000, 25000, 15000, 6000, 5000])]
    got = {r.path: r for r in budgets.neighbor_summary(frame(spark, rows)).collect()}
    assert got["d/0.py"].neighbors == ["d/1.py", "d/3.py", "d/5.py"]
    assert got["d/0.py"].neighbor_chars == 50000


def test_candidates_of_a_hot_directory(spark):
    # with evenly spread lengths the candidates of a task grow with the root of its files
    rng = random.Random(1)
    rows = [("hot", f"hot/m{i:05}.py", rng.randint(20, 2000)) for i in range(24000)]

    def kept(n):
        files = frame(spark, rows[:n], 4)
        local = files.sortWithinPartitions("dir", "path")
        return local.mapInPandas(budgets._candidates(3000), files.schema).count()

    assert kept(24000) < 2.5 * kept(6000) < 2.5 * 1000
    sizes = [r[2] for r in rows]
    got = {r.path: r.neighbors for r in budgets.neighbor_summary(frame(spark, rows, 4), 3000).collect()}
    shared = budgets._walk(sizes, 3000, None)
    assert got["hot/m23999.py"] == [rows[i][1] for i in shared]
    for owner in shared:
        assert got[rows[owner][1]] == [rows[i][1] for i in budgets._walk(sizes, 3000, owner)]


@pytest.mark.parametrize("seed", range(8))
def test_batches_match_the_fold(spark, seed):
    rng = random.Random(seed)
    sizes = [[0, 1, 50, 100, 101, 250], [10], [99, 2], [0], [300], list(range(60)), [0, 120], [1, 100]][seed]
    rows = random_rows(rng, 150, sizes)
    got = {r.path: r.batch for r in budgets.module_batches(frame(spark, rows), 100).collect()}
    assert got == brute_batches(rows, 100)


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([200000, 150000, 90000, 320000, 10], [0, 1, 1, 2, 3]),
        ([0, 310000, 5], [0, 1, 2]),
        ([100, 200], [0, 0]),
    ],
)
def test_batch_goldens(spark, sizes, want):
    rows = [("d", f"d/{i}", n) for i, n in enumerate(sizes)]
    got = budgets.module_batches(frame(spark, rows)).orderBy("path").collect()
    assert [r.batch for r in got] == want


def test_block_steps_agree_with_the_fold():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([0, 1, 3, 7, 20, 45, 101]) for _ in range(rng.randint(1, 30))]
        steps = budgets._block_steps(__import__("numpy").array(lengths), 100)
        for fill in [-1, *range(0, 140, 3)]:
            used, cuts = fill, 0
            for n in lengths:
                if used >= 0 and used + n > 100:
                    used, cuts = 0, cuts + 1
                used = max(used, 0) + n
            hit = [s for s in steps if s[0] <= fill <= s[1]]
            assert len(hit) == 1
            low, high, base, kept, got = hit[0]
            assert (base + (fill if kept else 0), got) == (used, cuts)


def test_totals(spark):
    rows = [("a", "a/1", 400_000), (".", "2", 1)]
    df = frame(spark, rows)
    assert budgets.total_chars(df).first().asDict() == {"total_chars": 400_001, "needs_batching": True}
    assert not budgets.total_chars(df.where(F.col("dir") == "a")).first().needs_batching
    assert budgets.total_chars(df.limit(0)).first().total_chars == 0
    assert {r.dir: (r.n_files, r.n_chars) for r in budgets.directory_totals(df).collect()} == {
        "a": (1, 400_000), ".": (1, 1)
    }
