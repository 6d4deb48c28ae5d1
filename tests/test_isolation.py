"""The engine without the training-data subpackage, or without a package that the subpackage needs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


def said(where: Path, before: str = "") -> str:
    env = os.environ | {"PYTHONPATH": str(where)}
    got = subprocess.run([sys.executable, "-W", "ignore", "-B", "-c", before + SAY], cwd=where, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    return got.stdout.split("\n")[-2]


def test_engine_without_the_subpackage(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    n, sql, any_llm = said(at).split()
    assert int(n) > 70 and int(sql) > 50 and any_llm == "False"


def test_engine_without_a_package_of_the_subpackage():
    n, _, any_llm = said(REPO, "import sys; sys.modules['zstandard'] = None; ").split()
    assert int(n) > 70 and any_llm == "False"
