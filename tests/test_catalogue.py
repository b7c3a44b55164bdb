"""The catalogue against DuckDB on the smallest tables."""

import pytest

from netfell.plans import catalogue
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
HELD = catalogue.oracles()


@pytest.mark.parametrize("name", sorted(HELD))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert rows_of(df) == rows_of_sql(duck, HELD[name])


def test_flagship_names_ten_nations(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and all(r.label for r in rows)


def test_entry_lists_every_query_with_sql_for_known_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
