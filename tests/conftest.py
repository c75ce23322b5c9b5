import pytest

from dumpquarry.session import builder


@pytest.fixture(scope="session")
def spark():
    session = builder("local[4]", 4).config("spark.driver.memory", "4g").config("spark.default.parallelism", "4").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
