"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import pytest
from oracle import assert_equal, duck

from marlow.plans.all_queries import FLAGSHIP, REGISTER

SF = os.environ.get("MARLOW_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTER.items() if q.sql))
def test_equals_sql(spark, con, name):
    assert_equal(REGISTER[name].run(spark, SF), REGISTER[name].sql, con)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTER.items() if not q.sql))
def test_runs(spark, name):
    assert REGISTER[name].run(spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_what_corpus_operators_need():
    """Where one of their modules is missing, the other queries still load."""
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['regex'] = None; sys.modules['marlow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p01_problem_list' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
