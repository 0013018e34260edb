"""The driver's entry file, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("keep_pipeline, keep_folder", [(False, False), (True, False), (True, True), (False, True)])
def test_queries_without_the_subpackage(tmp_path, keep_pipeline, keep_folder):
    shutil.copytree(ROOT / "fablespark", tmp_path / "fablespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if keep_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path)
    if keep_folder:
        (tmp_path / "fablespark/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 60 and said.stdout.split()[1:] == ["0", "False"]
