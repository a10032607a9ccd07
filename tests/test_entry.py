import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_have_names_and_sql():
    e = importlib.import_module("__spark_entry__")
    assert len(e.queries()) >= 30 and set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm():
    code = "import sys; sys.modules['rivergraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'upstream_closure' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
