import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from baitline.session import get_spark
    s = get_spark("local[4]", partitions=4, app="baitline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def msg_schema():
    return "msg_id long, text string, situation string, image string, demo_offline boolean"
