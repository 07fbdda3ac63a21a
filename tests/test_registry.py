"""The registry works where the training-data subpackage is left out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_core_queries_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "oracles.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "tickloom", tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) - set(q), 'pipeline' in q)"
    for unwanted in (), ("corpus_pipeline.py",):
        for name in unwanted:
            (tmp_path / name).unlink()
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        count, rest, pipeline = said.stdout.split()
        assert int(count) > 60 and (rest, pipeline) == ("set()", "False")
