import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from buzzscore.session import build_session

    ckpt = tempfile.mkdtemp(prefix="buzzscore-test-ckpt-")
    s = build_session(
        "local[4]",
        app_name="buzzscore-tests",
        shuffle_partitions=8,
        extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"},
    )
    yield s
    s.stop()


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
