"""The driver's entry module, with and without the subpackage that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tessera"):
        source, at = ROOT / name, tmp_path / name
        shutil.copytree(source, at, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, at)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "tessera" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
