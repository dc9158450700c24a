import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runlens.session import build  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Without merging of small partitions even little data spans several range partitions.
    session = build(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
