"""The entry point, with and without the training-data folder."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "agg_yield" in names


def test_without_the_llm_folder(tmp_path):
    """Everything else imports and is registered when that folder and the pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "tidewell"), tmp_path / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_yield' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidewell")):
        if not folder.endswith("llm") and "__pycache__" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "tidewell.llm" not in open(os.path.join(folder, f)).read(), f
