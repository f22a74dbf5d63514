import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from undertow.plans import Warehouse  # noqa: E402
from undertow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "undertow-tests", shuffle=2)


@pytest.fixture(scope="session")
def w(spark):
    return Warehouse(spark, "/root/testdata/sf0.001")


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
