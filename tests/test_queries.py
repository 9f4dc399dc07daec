"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridwarden.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    assert compare(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 100 and df.columns[0] == "id"


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_wrong_techniques_are_found(spark, duck):
    name = "technique_of_each_text"
    found = catalog.QUERIES[name](spark, SF)
    least = found.agg(F.min("technique_id")).first()[0]
    for wrong in ({"technique_id": F.lit(least)}, {"similarity": F.lit(0.0).cast("float")}):
        assert compare(found.withColumns(wrong), duck, catalog.SQL[name]) is not None
