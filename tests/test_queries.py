from __future__ import annotations

import pytest

from sonogrid.plans import catalog
from tests.parity import compare


#: Queries that the smallest tables leave without a row.
EMPTY = {"A16_minimax_regret"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_duckdb(spark, data, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], data) == ("no rows" if name in EMPTY else "")


def test_entry_names_its_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["bird_id", "macro_f1", "error_rate"]
