"""The entry module without the corpus folder, and without a library that only the folder needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    told = subprocess.run([sys.executable, "-W", "ignore", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"],
                          cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(folder)})
    return [line.split() for line in told.stdout.split("\n")[:2]]


@pytest.mark.parametrize("lacking", ["folder", "folder and pipeline", "library"])
def test_the_rest_works_without(tmp_path, lacking):
    shutil.copytree(f"{ROOT}/keyfold", tmp_path / "keyfold", ignore=shutil.ignore_patterns(
        "__pycache__", *(["llm"] if "folder" in lacking else [])))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{file}") and (file != "corpus_pipeline.py" or "pipeline" not in lacking):
            shutil.copy(f"{ROOT}/{file}", tmp_path)
    if lacking == "library":
        (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')\n")
    queries, oracle = names(tmp_path)
    assert "stage3_part1" in queries and "stage3_part1" in oracle
    assert not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
