"""The library stands without its training-data subpackage, with or without the pipeline module."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "ins05_god_class" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), sorted(names)
assert set(e.oracle_sql()) <= names
print("FINE")
"""


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_llm(tmp_path, pipeline_too):
    for name in ("codeloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    if pipeline_too:
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    told = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert told.stdout.strip().endswith("FINE"), told.stderr
