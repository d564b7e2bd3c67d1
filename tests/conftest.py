import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[*]", 8, app_name="tessera-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tessera-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tessera-test-")


SF_SMALL = "/root/testdata/sf0.001"
