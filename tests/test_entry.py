"""The entry point, with and without the folder of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from storystream.plans.catalog import QUERIES

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def names(folder):
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True)
    return [line.split() for line in run.stdout.splitlines()]


@pytest.mark.parametrize("emptied", [False, True])
def test_import_without_the_training_data_operators(tmp_path, emptied):
    """Also where the folder is there but holds no module any more."""
    shutil.copytree(ROOT / "storystream", tmp_path / "storystream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    if emptied:
        (tmp_path / "storystream" / "llm").mkdir()
    queries, sql = names(tmp_path)
    assert queries == list(QUERIES) and set(sql) <= set(queries)


def test_import_as_it_is():
    queries, sql = names(ROOT)
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    if (ROOT / "storystream" / "llm" / "queries.py").exists():
        assert {name.split("_")[0] for name in queries} >= {f"op{n}" for n in range(1, 14)}
