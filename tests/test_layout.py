"""The entry works without the operators for training data."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "pagemill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pagemill.llm" not in path.read_text(), path
