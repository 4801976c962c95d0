"""The entry points with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def listed(block: str) -> tuple[int, int, int]:
    """(queries, SQL texts, queries of the optional part) in a fresh interpreter in which some modules can't be imported."""
    code = f"import sys\nfor m in {block}: sys.modules[m] = None\nimport __spark_entry__ as e\nq, s = e.queries(), e.oracle_sql()\nassert set(s) <= set(q)\nprint(len(q), len(s), sum(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return tuple(map(int, out.split()))


def test_the_rest_works_without_the_optional_part():
    without = listed("['tessera.llm', 'corpus_pipeline']")
    assert without[2] == 0 and without[0] > 150
    whole = listed("[]")
    assert whole[0] - whole[2] == without[0]


def test_nothing_else_imports_the_optional_part():
    for file in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in file.parts:
            assert "tessera.llm" not in file.read_text(), file
