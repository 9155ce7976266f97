import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import build_session
    os.environ.setdefault("TAGLOOM_SCRATCH", tempfile.mkdtemp(prefix="tagloom-test-"))
    s = build_session(master="local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tagloom-t-")


SF_SMALL = "/root/testdata/sf0.001"
