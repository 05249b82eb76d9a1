"""Packing of files into tasks, hot folders, files written in two phases."""

import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from codecairn.sources import files
from codecairn.sources.export import write_texts
from codecairn.sources.files import first_fit, list_tree, pack_files, read_contents, scan_tree

ROOT = Path(__file__).resolve().parent.parent


def test_first_fit_is_that_of_a_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 3, 50, 99, 100, 250, rng.randint(0, 120)]) for _ in range(rng.randint(0, 40))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            need = min(sizes[i], 100)
            at = next((b for b, r in enumerate(room) if r >= need), len(room))
            room += [100] if at == len(room) else []
            room[at] -= need
            want[i] = at
        assert first_fit(sizes, 100) == want


def test_tasks_read_about_the_same_bytes(spark, monkeypatch):
    rng = random.Random(7)
    sizes = [int(rng.paretovariate(1.2) * 1000) % 400_000 for _ in range(5000)]
    listed = spark.createDataFrame([(f"f{i}", f"p{i}", s) for i, s in enumerate(sizes)], "file string, path string, size long")
    monkeypatch.setattr(files, "TASK_BYTES", 1 << 20)
    monkeypatch.setattr(files, "BLOCK_FILES", 1500)
    monkeypatch.setattr(files, "OPEN_BYTES", 0)
    tasks = pack_files(listed).groupBy("task").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    held = [t.bytes for t in tasks]
    assert sum(t.n for t in tasks) == 5000 and {t.task for t in tasks} == set(range(len(tasks)))
    assert max(held) <= 2 * sum(held) / len(held)


def test_hot_folder_is_listed_in_slices(spark, tmp_path, monkeypatch):
    for i in range(250):
        (tmp_path / f"f{i}.py").write_text("x" * i)
    (tmp_path / "f0.py").unlink()
    (tmp_path / "empty").mkdir()
    (tmp_path / ".hid.py").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "empty")
    monkeypatch.setattr(files, "SLICE", 7)
    listed = {(r.path, r.size) for r in list_tree(spark, str(tmp_path), "a/b").collect()}
    assert listed == {(f"a/b/f{i}.py", i) for i in range(1, 250)}
    assert read_contents(list_tree(spark, str(tmp_path))).agg(F.sum(F.length("content"))).first()[0] == sum(range(250))
    assert scan_tree(spark, f"file://{tmp_path}/empty").count() == 0


def test_files_with_one_path_and_empty_files(spark, tmp_path):
    rows = [("a/x.md", "one"), ("a/x.md", "two"), ("b.md", ""), ("c.md", None)]
    assert write_texts(spark.createDataFrame(rows, "path string, text string").repartition(3), f"file://{tmp_path}") == 3
    assert (tmp_path / "a/x.md").read_text() in ("one", "two")
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b.md", "c.md"}
    # written again, the files are replaced whole
    write_texts(spark.createDataFrame([("b.md", "new")], "path string, text string"), f"file://{tmp_path}")
    assert (tmp_path / "b.md").read_text() == "new" and (tmp_path / "c.md").read_text() == ""


KILL = """
import sys, os
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from codecairn.session import get_spark
from codecairn.sources.export import write_texts
from codecairn.sources.files import list_tree, read_contents
spark = get_spark(master="local[2, 3]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10"}})
spark.sparkContext.setLogLevel("OFF")

def dying(batches):
    from pyspark import TaskContext
    for k, batch in enumerate(batches):
        if k == 3 and TaskContext.get().attemptNumber() < {attempts}:
            os._exit(1)
        yield batch

rows = spark.range(100).repartition(2).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("path"), F.repeat(F.lit("text "), 50).alias("text"))
try:
    n = write_texts(rows.mapInArrow(dying, rows.schema), "file://{folder}")
except Exception:
    n = "failed"
back = read_contents(list_tree(spark, "file://{folder}"))
same = rows.join(back, "path").where(F.col("text") == F.col("content").cast("string")).count()
print("WROTE", n, back.count(), same)
"""


def killed(tmp_path, attempts):
    script = tmp_path / "kill.py"
    (tmp_path / "out").mkdir()
    script.write_text(KILL.format(root=str(ROOT), folder=f"{tmp_path}/out", attempts=attempts))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300)
    assert "WROTE" in done.stdout, done.stderr[-2000:]
    return done.stdout.split("WROTE")[1].split()


def test_a_killed_attempt_leaves_whole_files_only(tmp_path):
    assert killed(tmp_path, 1) == ["100", "100", "100"]


def test_a_failed_job_leaves_no_file(tmp_path):
    assert killed(tmp_path, 99) == ["failed", "0", "0"]
