"""Every query that has SQL, beside it on the smallest tables; the others run and have rows."""

import pytest
from conftest import SMALL
from oracle import differences, duck

from traceloom import catalog

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()
#: Slow to train; tests/test_model.py fits them on a few rows.
TRAINED = {"random_forest", "elasticnet", "logistic_classifier", "hard_vote_ensemble"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), duck(SMALL), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - TRAINED))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
