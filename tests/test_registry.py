"""The driver's contract, and that the library stands without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from gleanmill import registry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(registry.QUERIES) <= set(q)
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "gleanmill"):
        (tmp_path / name).symlink_to(ROOT / name)
    block = "import sys; sys.modules['gleanmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", block], cwd=tmp_path, check=True, timeout=60)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gleanmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "gleanmill").parts:
            assert "llm" not in path.read_text(), path
