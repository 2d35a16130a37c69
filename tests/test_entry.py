"""The entry module works with and without the removable parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') and q[2].isdigit() for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def counts(root) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-4:]


def test_without_the_removable_parts(tmp_path):
    for name in ("__spark_entry__.py", "roadpulse"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    n, pipeline, ops, ok = counts(tmp_path)
    assert int(n) > 30 and (pipeline, ops, ok) == ("False", "False", "True")


def test_with_what_is_there():
    n, pipeline, ops, ok = counts(ROOT)
    there = (ROOT / "roadpulse" / "llm").exists()
    assert ok == "True" and ops == str(there) and pipeline == str(there and (ROOT / "corpus_pipeline.py").exists())
