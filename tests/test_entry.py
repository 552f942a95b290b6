"""The driver entry without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CALL = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'detect_counts' in q; print(len([n for n in q if n.startswith('op') or n == 'pipeline']))"


@pytest.mark.parametrize("gone", [["quillspan/llm"], ["quillspan/llm", "corpus_pipeline.py"]])
def test_entry_without_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "quillspan"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", CALL], cwd=tmp_path, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == "0"
