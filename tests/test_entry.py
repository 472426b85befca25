"""The entry module with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "sightline.llm" or name.startswith("sightline.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "annotated_results" in q and "annotated_stream" in o and set(o) <= set(q), sorted(q)
assert not [k for k in q if k.startswith("op") or k == "pipeline"], sorted(q)
"""

BROKEN = """
import sys

class Broken:
    def find_spec(self, name, path=None, target=None):
        if name == "tiktoken_of_another_kind":
            return None
        if name == "sightline.llm.queries":
            raise ModuleNotFoundError("No module named 'pandas_like'", name="pandas_like")

sys.meta_path.insert(0, Broken())
import __spark_entry__ as e
try:
    e.queries()
except ModuleNotFoundError:
    sys.exit(0)
sys.exit(1)
"""


def _python(code: str) -> int:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode


def test_entry_without_the_subpackage():
    assert _python(WITHOUT) == 0


def test_other_import_errors_are_raised():
    if os.path.isdir(os.path.join(ROOT, "sightline", "llm")):
        assert _python(BROKEN) == 0


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "sightline")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as src:
                    assert "llm" not in src.read(), f
