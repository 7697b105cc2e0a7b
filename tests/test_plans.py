"""Every registered query against its SQL twin."""

import pytest

import tallygrove.plans.registry as registry
from tests.conftest import TINY
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, TINY)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        compare(df, con, sql)


def test_flagship(spark):
    assert registry.flagship(spark, TINY).count() > 0


def test_entry_module_without_llm(spark, tmp_path):
    """The entry module still imports, with its other queries, when the llm folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__.replace("/plans/", "/"))))
    shutil.copytree(f"{root}/tallygrove", tmp_path / "tallygrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k[:2] == 'op' and k[2].isdigit() for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
