"""The driver's entry with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(at: Path) -> list[set[str]]:
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=at, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()[-2:]]


def copied(to: Path) -> Path:
    shutil.copytree(REPO / "veristrata", to / "veristrata", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", to)
    return to


def test_entry_without_operators(tmp_path):
    from veristrata.plans.queries import ORACLES, QUERIES

    at = copied(tmp_path)
    for made in (lambda: None, lambda: (at / "corpus_pipeline.py").write_text("from veristrata.llm import packing\n"), lambda: (at / "veristrata/llm").mkdir()):
        made()  # nothing, a pipeline without its operators, an empty folder
        assert names(at) == [set(QUERIES), set(ORACLES)]


def test_errors_inside_present_modules_show(tmp_path):
    at = copied(tmp_path)
    (at / "veristrata/llm").mkdir()
    (at / "veristrata/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=at, capture_output=True, text=True)
    assert out.returncode and "no_such_module" in out.stderr


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
