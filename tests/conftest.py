import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from trawl.session import local_session

    s = local_session("*", shuffle_partitions=8, app="trawl-tests")
    yield s


@pytest.fixture
def corpus(spark):
    """Build a corpus DataFrame from ``{path: text}``."""

    def make(files: dict, mtimes: dict | None = None):
        rows = [(p, t, float((mtimes or {}).get(p, 0.0))) for p, t in files.items()]
        return spark.createDataFrame(rows, "path string, text string, mtime double")

    return make
