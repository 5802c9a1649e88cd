"""Every query with an SQL oracle gives the oracle's rows; the others give rows at all."""

import pytest
from oracle import DATA, agree

import __spark_entry__ as entry

QUERIES = {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        agree(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
