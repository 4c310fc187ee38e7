"""The driver's contract, with and without the training-data subpackage."""

import importlib
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["bin", "n"] and out.count() > 0


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_works_without_the_subpackage(tmp_path, pipeline_too):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/tessera", f"{tmp_path}/tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if not pipeline_too and os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hist_128' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_other_missing_modules_are_errors(monkeypatch):
    real = __import__

    def failing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("no such thing", name="xxhash")
        return real(name, *args, **kwargs)

    monkeypatch.setattr("builtins.__import__", failing)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
