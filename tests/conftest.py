import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from relyscope.session import checkpoint_dir, local_session

    s = local_session(cores="*", shuffle_partitions=8, app="relyscope-tests")
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="relyscope-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="relyscope-out-")
