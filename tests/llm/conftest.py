import pytest


@pytest.fixture(scope="session")
def shipped(spark):
    from keystead.llm.tables import ship

    ship(spark)
    return spark
