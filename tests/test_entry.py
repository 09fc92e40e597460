"""The driver's entry module, in a process of its own without a session."""

import shutil
import subprocess
import sys

from .conftest import ROOT

LIST = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def _listed(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(eval(line)) for line in out.stdout.splitlines()]


def test_queries_are_listed_before_a_session_exists():
    queries, oracles = _listed(ROOT)
    assert oracles <= queries and "screen_files" in queries


def test_queries_are_listed_without_the_llm_folders(tmp_path):
    for name in ("tidegate", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    queries, _ = _listed(tmp_path)
    assert "screen_files" in queries and not any(q.startswith("op1_") for q in queries) and "pipeline" not in queries
