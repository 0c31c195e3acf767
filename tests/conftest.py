import pytest

from litquarry.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
