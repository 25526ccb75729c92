"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    assert {r["category"] for r in entry.entry(spark).collect()} == {"critical", "order", "low-stock", "expected", "delayed", "ok"}


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    for name in ("trestle", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "trestle/llm")], check=True)
    code = "import __spark_entry__ as e; names = list(e.queries()); assert 'control_counts' in names and not any(n.startswith('op') for n in names)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
