"""The library and its entry file stand without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = """
import __spark_entry__ as e, bench
from seqloom.sources import files
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
