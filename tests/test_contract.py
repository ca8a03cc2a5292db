"""Every query that has SQL gives the rows of that SQL, on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("without", [["tickerpulse/llm", "tests/llm"], ["tickerpulse/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_imports_without_the_optional_operators(tmp_path, without):
    root = Path(contract.__file__).parent
    skipped = {root / w for w in without}
    ignore = lambda folder, names: [n for n in names if Path(folder) / n in skipped or n.startswith(".") or n == "__pycache__"]
    shutil.copytree(root, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as c, tests.compare; print(sorted(k for k in c.queries() if k == 'pipeline' or k[:2] == 'op' and k[2:3].isdigit()), len(c.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert done.stdout.startswith("[] ") and int(done.stdout.split()[1]) > 80
