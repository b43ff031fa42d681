import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "hopweave", tmp_path / "hopweave", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "hopweave" / "llm" / "__pycache__").mkdir(parents=True)  # an empty folder may stay behind
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, pipeline, oracles = said.stdout.split()
    assert int(n) == int(oracles) > 60 and pipeline == "False"
