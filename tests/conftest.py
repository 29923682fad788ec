import pytest

from truthframe.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", "local[4]", 4)
