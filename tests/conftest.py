import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from cellsight.session import create_session
    session = create_session("cellsight-tests", master="local[4]", shuffle_partitions=4,
                             extra={"spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    # Use the configured checkpoint folder; set one only where none is configured.
    from cellsight.session import checkpoint_root
    checkpoint_root(session)
    yield session
    session.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="cellsight-test-")
