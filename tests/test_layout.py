"""What the folders promise: the core stands without the operators of tessera/llm and without the pipeline."""

import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_in_the_core_imports_the_operators():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imported(path) if m.startswith(("tessera.llm", "corpus_pipeline"))], path


def test_entry_without_the_operators():
    """With both modules out of reach, the core's queries and SQL are still there; any other failing import is an error."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in (GONE):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""
    run = lambda gone: subprocess.run([sys.executable, "-c", code.replace("GONE", gone)], capture_output=True, text=True)
    without = run("'tessera.llm', 'corpus_pipeline'")
    n = [int(x) for x in without.stdout.split()]
    assert n and n[0] == n[1] > 50, without.stderr
    if (ROOT / "tessera" / "llm").exists():
        assert run("'zstandard',").returncode != 0
