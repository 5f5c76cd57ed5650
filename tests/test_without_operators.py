"""The rest of the repository works without the folders of the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

TOP = pathlib.Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))"


@pytest.mark.parametrize("left", ["folders", "bare folder", "pipeline too"])
def test_entry_loads_without_them(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", *(["corpus_pipeline.py"] if left == "pipeline too" else [])))
    if left == "bare folder":
        (copy / "specaudit" / "llm").mkdir()
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n, pipeline, operators = out.stdout.split()
    assert int(n) > 200 and pipeline == operators == "False"
