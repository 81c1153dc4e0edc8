"""Every registered query of the library's own operators gives the rows of its SQL, or else rows of a stable schema."""

import subprocess
import sys

import pytest
from compared import oracle_rows, spark_rows
from conftest import ROOT

from leafmill import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_those_of_the_sql(name, spark, sf_dir):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == oracle_rows(registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_without_sql_repeat(name, spark, sf_dir):
    columns, rows = spark_rows(registry.QUERIES[name](spark, sf_dir))
    assert columns and rows
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == (columns, rows)


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
