import pytest

from clauselake.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs or longer tuples."""

    def build(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(list(rows), schema)

    return build
