"""The package as executors elsewhere get it."""

import subprocess
import sys

from runloom.session import packed


def test_the_zip_is_the_package(tmp_path):
    found = subprocess.run([sys.executable, "-c", "import runloom.operators.runs as r; print(r.__file__)"], cwd=tmp_path, env={"PYTHONPATH": packed()}, capture_output=True, text=True)
    assert "runloom.zip" in found.stdout, found.stderr
