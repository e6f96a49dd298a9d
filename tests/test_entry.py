"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"


def ask(folder):
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def copy(folder, without):
    shutil.copytree(ROOT / "pagequarry", folder / "pagequarry", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "llm" in without else [])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, folder)


def test_entry_without_the_subpackage(tmp_path):
    copy(tmp_path, ["llm"])
    n, some = ask(tmp_path)
    assert int(n) >= 32 and some == "False"


def test_entry_without_subpackage_and_pipeline(tmp_path):
    copy(tmp_path, ["llm", "corpus_pipeline.py"])
    n, some = ask(tmp_path)
    assert int(n) >= 32 and some == "False"
