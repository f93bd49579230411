"""Every registered report equals its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as driver
import check

SF = "/root/testdata/sf0.001"
STATEMENTS = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_statement_has_a_report():
    assert set(STATEMENTS) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 150


@pytest.mark.parametrize("name", list(driver.queries()))
def test_report(spark, con, name):
    good, note = check.compare(spark, con, SF, name, STATEMENTS.get(name))
    assert good, note


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A report with Python tasks runs from a folder where workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as d\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', d.queries()['dense_search'](s, {SF!r}).count())\n"
    )
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 320" in out.stdout, out.stderr[-2000:]
