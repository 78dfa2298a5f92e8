"""The engine without its training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from lzseq import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["lzseq/llm", "tests/llm"], ["lzseq/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_file_without_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        shutil.rmtree(copy / path, ignore_errors=True)
        (copy / path).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries()); import bench"
    env = os.environ | {"PYTHONPATH": str(copy)}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == sorted(catalogue.queries())
