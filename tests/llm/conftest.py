import pytest



@pytest.fixture(scope="session")
def make(spark):
    """Builds a frame from rows and a schema."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build
