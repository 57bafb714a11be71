import pytest
from conftest import DATA, same

import lattica.plans.queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same(q.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL) - {"ccl_labels_large"}))
def test_query_without_sql_has_rows(spark, name):
    assert q.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(q.QUERIES) <= set(e.queries())


def test_entry_needs_no_session():
    """Queries and their SQL are there before any session is."""
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.strip() == "True"
