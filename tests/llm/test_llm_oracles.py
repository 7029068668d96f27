import pytest
from compare import same_rows

from tidewell.llm import queries as Q

NAMES = sorted(Q.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, duck, name):
    same_rows(Q.queries()[name](spark, sf), duck, Q.oracle_sql()[name])


def test_native_operators_have_no_python_in_their_plans(spark, sf):
    for n in (3, 7, 10):
        name = next(k for k in Q.queries() if k.startswith(f"op{n}_"))
        plan = Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_import_guard():
    """With this part deleted, the entry module still imports."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidewell.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "tpch_q1" in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
