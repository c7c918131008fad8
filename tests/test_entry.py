from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["signal", "contig", "start", "stop", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    """The rest works where their folders have been deleted, whether the pipeline's file stays or goes."""
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'signal_segments' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text(), p
