"""The driver's entry without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    count, same = run.stdout.split()
    assert int(count) > 70 and same == "True"


def test_pipeline_file_alone_is_not_imported(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    run = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print('pipeline' in e.queries())"],
        cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"},
    )
    assert run.stdout.strip() == "False", run.stderr
