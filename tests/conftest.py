import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from touchpoint.session import checkpoint_dir, get_session

    s = get_session("local[4]", app_name="touchpoint-tests", shuffle_partitions=4)
    # tests only: a fresh scratch folder when the cluster names none
    checkpoint_dir(s, tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def scratch():
    """A new scratch folder per test (never cleared)."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
