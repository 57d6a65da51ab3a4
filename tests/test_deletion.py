"""Without the folder of training-data operators the rest works."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_it(tmp_path):
    shutil.copytree(ROOT / "tallyweave", tmp_path / "tallyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pair_best' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "tallyweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
