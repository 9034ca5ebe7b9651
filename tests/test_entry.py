from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_derived_tables_are_built_again_when_gone(spark):
    from vellumgrid.plans import base

    small = "/root/testdata/sf0.001"
    first = base.edges(spark, small).count()
    folder, there = base._place(spark, small, "edges")
    assert there and base._place(spark, small, "edges") == (folder, True)
    shutil.rmtree(folder.removeprefix("file:"))
    assert base.edges(spark, small).count() == first


def test_entry_without_the_optional_parts(tmp_path):
    """The other queries stay when the optional subpackage is deleted."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "vellumgrid", tmp_path / "vellumgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    n, m, ops = out.stdout.split()
    assert int(n) > 50 and int(m) > 45 and ops == "False", out.stderr
