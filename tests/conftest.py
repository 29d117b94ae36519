import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from saleloom.session import local_session
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def con(sf_dir):
    from check_queries import duck
    return duck(sf_dir)


@pytest.fixture(scope="session")
def dense(spark, sf_dir):
    """The dense panel of the smallest data, stored once."""
    from saleloom.catalog import inputs
    from saleloom.session import cut_lineage
    return cut_lineage(inputs.dense(spark, sf_dir))
