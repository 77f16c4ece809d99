"""The entry point with and without the optional subpackage."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts(tmp_path):
    """A copy without the subpackage and the pipeline still imports and has the core queries."""
    import shutil

    shutil.copytree(os.path.join(HERE, "collinea"), tmp_path / "collinea", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'near_parallel_blocked' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(HERE, "collinea")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                assert "collinea.llm" not in open(os.path.join(folder, name)).read()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["i", "j", "distance"] and df.count() > 0
