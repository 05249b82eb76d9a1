"""Line diffs, ranks within groups, the answer loop."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from codecairn.functions.diff import hunks, line_changes
from codecairn.operators.changes import file_changes
from codecairn.operators.ranking import rank_within
from codecairn.plans.answers import Answers
from codecairn.sources.generators import TemplateGenerator


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(11)
    for _ in range(400):
        letters = "abcdefghij"[: rng.randint(1, 10)]
        a = rng.choices(letters, k=rng.randint(0, 30))
        b = rng.choices(letters + "xyz", k=rng.randint(0, 30)) if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        gone, come = line_changes(a, b)
        assert [x for i, x in enumerate(a) if i not in gone] == [x for i, x in enumerate(b) if i not in come]
        assert len(a) - len(gone) == common(a, b)


def test_long_texts():
    old = [f"line {i}" for i in range(60_000)]
    new = [x for i, x in enumerate(old) if i % 3000] + ["end"]
    gone, come = line_changes(old, new)
    assert (gone, come) == (list(range(0, 60_000, 3000)), [len(new) - 1])
    assert line_changes(old, [f"other {i}" for i in range(60_000)]) == (list(range(60_000)), list(range(60_000)))


def test_hunks():
    a, b = ["a", "b", "c", "d"], ["x", "a", "c", "e", "f"]
    assert hunks(a, b, *line_changes(a, b)).split("\n") == ["@@ -1,0 +1,1 @@", "+x", "@@ -2,1 +3,0 @@", "-b", "@@ -4,1 +4,2 @@", "-d", "+e", "+f"]
    rng = random.Random(3)
    for _ in range(50):
        a, b = (rng.choices("abc", k=rng.randint(0, 12)) for _ in range(2))
        signs = [line[0] for line in hunks(a, b, *line_changes(a, b)).split("\n") if line]
        want = [line[0] for line in difflib.ndiff(a, b) if line[0] in "+-"]
        assert signs.count("+") - signs.count("-") == want.count("+") - want.count("-") == len(b) - len(a)


def test_file_changes(spark):
    rows = lambda data: spark.createDataFrame(data, "path string, source_hash string, source string")
    old = rows([("same", "1", "x"), ("gone", "2", "a\nb"), ("edit", "3", "a\nb\nc"), ("null", None, None)])
    new = rows([("same", "1", "x"), ("new", "4", "a"), ("edit", "5", "a\nc\nd"), ("null", "6", "")])
    got = {r.path: (r.status, r.added, r.removed) for r in file_changes(old, new).collect()}
    assert got == {"gone": ("removed", 0, 2), "new": ("added", 1, 0), "edit": ("changed", 1, 1), "null": ("added", 1, 0)}
    assert file_changes(old.limit(0), new.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 40])
def test_ranks_of_a_group_that_lies_in_many_tasks(spark, width):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", None, "a", "b", f"g{i % 50}"]), rng.randint(0, 30), i) for i in range(3000)]
    df = spark.createDataFrame(data, "host string, k int, id int").repartition(5)
    got = {(r.host, r.id): r.rank for r in rank_within(df, "host", ["k", "id"], width=width).collect()}
    want, seen = {}, {}
    for host, k, i in sorted(data, key=lambda d: (str(d[0]), d[1], d[2])):
        seen[host] = want[host, i] = seen.get(host, 0) + 1
    assert got == want
    if width == 40:
        df = rank_within(df, "host", ["k", "id"], width=width)
        parts = df.where("host = 'hot'").select(F.spark_partition_id()).distinct().count()
        assert parts > 10
    assert rank_within(df.limit(0), "host", ["k", "id"], "r").count() == 0


def test_answer_loop(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    folder = str(marks)

    class Here(TemplateGenerator):
        """Fails for some requests always, for some at first, for none at times."""

        def __call__(self, prompt, max_tokens):
            import os

            place = os.path.join(folder, str(max_tokens))
            tried = len(open(place).read()) if os.path.exists(place) else 0
            with open(place, "a") as out:
                out.write("x")
            if max_tokens % 5 == 0 or (max_tokens % 7 == 0 and tried == 0):
                raise RuntimeError(f"no {max_tokens}")
            return super().__call__(prompt, max_tokens)

    asked = spark.createDataFrame([(i, f"p{i % 30}", i % 30) for i in range(40)], "k int, prompt string, max_tokens int")
    loop = Answers(spark, f"file://{tmp_path}/attempts", "template", "1", Here)
    got = {r.k: r for r in loop.ask(asked, ["k"]).collect()}
    assert len(got) == 40
    for i, r in got.items():
        n = i % 30
        if n % 5 == 0:
            assert (r.state, r.attempts, r.response, r.error) == ("failed", 3, None, f"RuntimeError: no {n}")
        else:
            assert (r.state, r.attempts, r.error) == ("answered", 2 if n % 7 == 0 else 1, None) and r.response
    # equal requests were sent once, and only what failed is asked for by the next run
    sent = {int(p.name): len(p.read_text()) for p in marks.iterdir()}
    assert sent == {n: 3 if n % 5 == 0 else 2 if n % 7 == 0 else 1 for n in range(30)}
    later = Answers(spark, f"file://{tmp_path}/attempts", "template", "2", Here).ask(asked, ["k"])
    assert {r.attempts for r in later.where("state = 'answered'").collect()} == {0}
    assert {int(p.name) for p in marks.iterdir() if len(p.read_text()) > sent[int(p.name)]} == set(range(0, 30, 5))
    assert loop.attempts().where("run = '1'").count() == 24 - 4 + 4 * 2 + 6 * 3
