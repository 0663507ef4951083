"""The library and its entry work in a copy that lacks the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), 'pipeline' in names, any(n.startswith('op1_') for n in names))"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline"])
def test_the_entry_imports_without_the_folders(tmp_path, left):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    if left != "the pipeline":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    if left == "an empty folder":
        (copy / "fundweave" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    count, pipeline, training = done.stdout.split()
    assert int(count) > 100 and pipeline == training == "False"
