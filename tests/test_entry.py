"""The entry works without the corpus operators, whatever is left of their folder."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print('NAMES', *e.queries(), 'ORACLE', *e.oracle_sql())"


def names(root):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    found = out.stdout.rpartition("NAMES")[2].split()
    return set(found[:found.index("ORACLE")]), set(found[found.index("ORACLE") + 1:])


@pytest.fixture
def bare(tmp_path):
    """A copy of the repository's code without the corpus operators."""
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(REPO, "keysweep"), tmp_path / "keysweep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    return tmp_path


def test_without_the_folder(bare):
    queries, oracle = names(bare)
    assert "repo_risk" in queries and not any(q.startswith("op") or q == "pipeline" for q in queries)
    assert oracle <= queries and len(oracle) >= 57


@pytest.mark.parametrize("left", ["__pycache__/x.pyc", "__init__.py", "broken"])
def test_with_leftovers(bare, left):
    (bare / "keysweep/llm/__pycache__").mkdir(parents=True)
    if left == "broken":
        (bare / "keysweep/llm/__init__.py").write_text("import no_such_module_anywhere\n")
    else:
        (bare / "keysweep/llm" / left).write_text("")
    (bare / "corpus_pipeline.py").write_text("from keysweep.llm.common import read\n")
    assert names(bare)[0] == names(bare)[0] | {"repo_risk"} and "pipeline" not in names(bare)[0]


def test_whole_repository():
    queries, oracle = names(REPO)
    assert oracle <= queries
    if os.path.exists(os.path.join(REPO, "keysweep", "llm", "__init__.py")):
        assert any(q.startswith("op1_") for q in queries)
