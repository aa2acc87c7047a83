import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from labelforge.session import build_session, release_scratch
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s
    release_scratch(s)
    s.stop()


SMALL = "/root/testdata/sf0.001"
