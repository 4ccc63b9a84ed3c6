import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import checkpoint_dir, get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="tidemark-tests")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tidemark-test-", dir="/tmp")


SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
