import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowlens.session import get_session
    ck = tempfile.mkdtemp(prefix="flowlens-test-ckpt-")
    s = get_session("local[*]", app="flowlens-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ck, "spark.driver.memory": "8g"})
    yield s
    s.stop()
