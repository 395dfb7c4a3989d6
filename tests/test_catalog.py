import sys

import pytest
from compare import differences
from tallyfield.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and not n.startswith(("ml_15", "ml_22", "ml_23"))))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_guard(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # can't be imported
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)
