import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cartable.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="cartable-test-")


SF = "/root/testdata/sf0.001"
