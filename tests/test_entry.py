"""The driver's entry points, with and without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not os.path.isdir(__spark_entry__.SMOKE_DIR), reason="the test tables aren't here")
def test_flagship_query(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["product", "start_day", "period_type", "dataset_count", "busiest_day"]
    assert out.count() > 0


def test_every_oracle_has_its_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert oracles.keys() <= queries.keys()
    assert len(queries) > 50


def test_everything_else_works_without_the_text_operators(tmp_path):
    shutil.copytree(REPO / "eocatalog", tmp_path / "eocatalog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [n for n in q if n[:2] == 'op' or n == 'pipeline'], q; assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_an_error_inside_the_text_operators_is_not_hidden(tmp_path):
    shutil.copytree(REPO / "eocatalog", tmp_path / "eocatalog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_library" in done.stderr
