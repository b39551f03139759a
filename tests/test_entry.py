"""The entry without the parts that may be left out, and with parts that are broken."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(e.oracle_sql()) <= set(q))"


def run(at):
    return subprocess.run([sys.executable, "-c", CODE], cwd=at, capture_output=True, text=True, timeout=120)


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "seqlake"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    return tmp_path


@pytest.mark.parametrize("rest", ["nothing", "an empty folder"])
def test_without_the_parts_that_may_be_left_out(copy, rest):
    shutil.rmtree(copy / "seqlake" / "llm", ignore_errors=True)
    if rest != "nothing":
        (copy / "seqlake" / "llm" / "__pycache__").mkdir(parents=True)
    done = run(copy)
    assert done.stdout.split()[1:] == ["False", "False", "True"] and int(done.stdout.split()[0]) > 90, done.stderr


def test_a_broken_part_is_an_error(copy):
    (copy / "seqlake" / "llm").mkdir(exist_ok=True)
    (copy / "seqlake" / "llm" / "__init__.py").write_text("")
    (copy / "seqlake" / "llm" / "queries.py").write_text("import a_library_that_is_absent\n")
    assert "a_library_that_is_absent" in run(copy).stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "seqlake").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?m)^\s*(from|import)\s.*\bllm\b", p.read_text()), p
