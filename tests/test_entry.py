"""The driver's contract, also without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
#: Without the path of the original: a copy must import its own modules only.
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}


def said_by(folder: Path, code: str) -> subprocess.CompletedProcess:
    lead = f"import sys; sys.path.insert(0, {str(folder)!r}); "
    return subprocess.run([sys.executable, "-P", "-c", lead + code], cwd=folder, env=ENV, capture_output=True, text=True)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[-1] == "status" and df.count() > 0


def test_names_agree():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 60


@pytest.mark.parametrize("gone", [["countloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_without_the_training_data_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-*", *[g.rpartition("/")[2] for g in gone if "/" not in g]))
    for g in gone:
        if (tmp_path / "r" / g).is_dir():
            shutil.rmtree(tmp_path / "r" / g)
    said = said_by(tmp_path / "r", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())")
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 50


def test_a_broken_operator_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-*"))
    package = tmp_path / "r/countloom/llm"
    if not package.is_dir():
        pytest.skip("the operators are not here")
    (package / "queries.py").write_text("import a_module_that_is_not_there\n")
    said = said_by(tmp_path / "r", "import __spark_entry__")
    assert said.returncode and "a_module_that_is_not_there" in said.stderr


def test_command_line():
    said = subprocess.run([sys.executable, "-m", "countloom", "list"], cwd=ROOT, capture_output=True, text=True, check=True)
    assert "reconcile_status" in said.stdout.split()
