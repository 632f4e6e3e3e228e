import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fieldreports.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="fieldreports-tests")
    assert s.sparkContext.getCheckpointDir()
    yield s


@pytest.fixture(scope="session")
def written_source(spark):
    """Facts of sf0.001 written once (year-partitioned) to a fresh scratch folder."""
    from fieldreports.sources import FactSource

    return FactSource(spark, SF_SMALL).materialise()
