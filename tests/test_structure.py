"""The library stands without the training-data subpackage, and queries and SQL belong together."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "gridloom"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for f in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'agg_pricing_summary' in e.queries(), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, flagship, numbered = said.stdout.split()
    assert int(n) > 50 and flagship == "True" and numbered == "False"


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "gridloom.llm" not in f.read_text(), f
