import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from assaylake.session import local_session
    return local_session(8, "assaylake-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
