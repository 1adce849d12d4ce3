"""The driver's three functions, the guard around the optional parts, and what imports what."""

import os
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_text_operators():
    for path in [*(REPO / "heronq").rglob("*.py"), *(REPO / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"^\s*(from|import) (heronq\.llm|corpus_pipeline)|^\s*from heronq import .*\bllm\b", path.read_text(), re.M), path


def test_entry_works_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(REPO / "heronq", tmp_path / "heronq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(x.startswith('op') or x == 'pipeline' for x in q if x != 'offset'), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
