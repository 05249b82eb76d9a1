"""Registered queries of the subpackage: all present, and equal to their SQL where there is one."""

import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from codecairn.llm import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_one_query_per_operator_and_the_pipeline():
    names = set(driver.queries())
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.queries()) | {"pipeline"} <= names
    assert set(registry.oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = connect(DATA)
    assert difference(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], DATA) is None


def test_nothing_else_imports_the_subpackage():
    used = [p for p in (ROOT / "codecairn").rglob("*.py") if "llm" not in p.parts and "codecairn.llm" in p.read_text()]
    assert used == []


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for source in (ROOT / "codecairn").rglob("*.py"):
        if "llm" not in source.parts:
            to = tmp_path / source.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(source.read_text())
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=60)
