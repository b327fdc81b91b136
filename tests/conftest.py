import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from matchdesk.session import local_session
    s = local_session(master="local[4]", app="matchdesk-tests",
                      **{"spark.sql.shuffle.partitions": "8", "spark.sql.maxMetadataStringLength": "2000"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.oracle_check import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def m_small(spark):
    from matchdesk.sources import inputs as IN
    return IN.matches(spark, SF_SMALL)


@pytest.fixture(scope="session")
def m_mid(spark):
    from matchdesk.sources import inputs as IN
    return IN.matches(spark, SF_MID)
