"""The driver's contract, and that the rest stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 140 and set(oracles) <= set(queries)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and [r["priority_score"] for r in rows] == sorted((r["priority_score"] for r in rows), reverse=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "muster").rglob("*.py"):
        if "llm" not in path.parts:
            assert "muster.llm" not in path.read_text(), path


def test_stands_without_llm():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('muster.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'priority_queue' in e.queries() and not [k for k in e.queries() if k.startswith('op1')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
