"""The entry module with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [set(line.split()) for line in done.stdout.splitlines()]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    queries, sql = names(tmp_path)
    whole, _ = names(ROOT)
    assert queries == {n for n in whole if not n.startswith("op") and n != "pipeline"} and sql <= queries and len(queries) >= 94


def test_entry_does_not_hide_what_is_missing_inside(tmp_path):
    shutil.copytree(ROOT / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "maskwright" / "llm").mkdir()
    (tmp_path / "maskwright" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
