"""The entry imports and serves the rest where the training-text parts are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *e.queries())"
    env = {**os.environ, "PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()[2:]


def copied(folder, *without):
    skip = shutil.ignore_patterns("__pycache__", ".git", *without)
    shutil.copytree(ROOT, folder, ignore=skip)
    return folder


def test_the_rest_stands_alone(tmp_path):
    whole = names(copied(tmp_path / "whole"))
    text = [q for q in whole if q == "pipeline" or (q.startswith("op") and q[2].isdigit())]
    for without in (("llm",), ("llm", "corpus_pipeline.py")):
        assert names(copied(tmp_path / "-".join(without), *without)) == [q for q in whole if q not in text]
    some = names(copied(tmp_path / "operators", "corpus_pipeline.py"))
    assert "pipeline" not in some and len([q for q in some if q in text]) == len([q for q in text if q != "pipeline"])
