"""The driver contract holds with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def listed(folder: str) -> tuple[set[str], set[str]]:
    env = os.environ | {"PYTHONPATH": folder}
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout
    names, sql = (set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL")))
    return names, sql


@pytest.mark.parametrize("gone", [["voxlattice/llm", "tests/llm"], ["voxlattice/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_the_subpackage(tmp_path, gone):
    folder = str(tmp_path / "repo")
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
    names, sql = listed(folder)
    assert len(names) > 100 and sql <= names
    assert "pipeline" not in names and not any(name[:2] == "op" and name[2].isdigit() for name in names)
