"""The driver's entry module, whole and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["key", "count", "percent"] and got.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 78


def test_the_rest_imports_without_the_operators(tmp_path):
    """A copy of the repository without wakeline/llm, its tests and the pipeline."""
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".hypothesis", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 78 and not any(n.startswith('op') or n == 'pipeline' for n in q); import wakeline.api, wakeline.__main__, wakeline.streaming.streams, bench"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=there, check=True, timeout=120)
    assert not [p for p in there.rglob("*.py") if p.name != "test_entry.py" and p.name != "__spark_entry__.py" and "wakeline.llm" in p.read_text()]
