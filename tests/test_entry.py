"""The driver contract, with and without the corpus operators."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print('KNOWN', sorted(q)); print('SQL', sorted(s))"


def without(tmp_path, *hidden):
    """A copy of the checkout by links, without some of its files and folders."""

    def link(rel):
        for name in os.listdir(os.path.join(HERE, rel)):
            path = os.path.join(rel, name)
            if path in hidden or name in (".git", "__pycache__"):
                continue
            if any(h.startswith(path + os.sep) for h in hidden):
                os.makedirs(tmp_path / path)
                link(path)
            else:
                os.makedirs((tmp_path / path).parent, exist_ok=True)
                os.symlink(os.path.join(HERE, path), tmp_path / path)

    link("")
    # links are followed, so the copy alone is on the path
    done = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return {line.split(" ", 1)[0]: eval(line.split(" ", 1)[1]) for line in done.stdout.splitlines() if line.startswith(("KNOWN", "SQL"))}


@pytest.mark.parametrize("hidden", [("gleanery/llm", "tests/llm", "corpus_pipeline.py"), ("gleanery/llm", "tests/llm")])
def test_entry_stands_without_the_corpus_operators(tmp_path, hidden):
    from gleanery.plans.registry import QUERIES, SQL

    got = without(tmp_path, *hidden)
    assert got == {"KNOWN": sorted(QUERIES), "SQL": sorted(SQL)}


def test_entry_stands_without_the_pipeline(tmp_path):
    got = without(tmp_path, "corpus_pipeline.py")
    assert "pipeline" not in got["KNOWN"]
