import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Makes a table from rows with clashing extra columns, spread over several partitions."""

    def make(data, schema, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make
