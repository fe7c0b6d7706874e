"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent

BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("stridelake.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_keys():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 150


def test_without_the_subpackage():
    r = subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert r.returncode == 0, r.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "stridelake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "stridelake.llm" not in p.read_text(), p


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "variant" and df.count() == 5
