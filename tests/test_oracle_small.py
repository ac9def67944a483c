"""Every catalogue query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison on sf0.01)."""
import pytest

import __spark_entry__ as entry
from shopfloor.plans import catalog
from oracle_harness import compare, duck_connect
from conftest import SMALL

SQL = entry.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SMALL)


def test_every_query_of_the_catalogue_has_an_oracle():
    # Those that SQL cannot express are all of the training-data operators and their pipeline.
    without = set(entry.queries()) - set(SQL)
    assert without <= set(entry._training_queries()[0])
    assert set(catalog.queries()) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    result = compare(df, duck, SQL[name])
    assert result["schema_match"], result
    assert result["rows_spark"] == result["rows_oracle"], result
    assert result["hash_match"], result
    assert not result["type_mismatches"], result


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["product_name", "revenue"]
