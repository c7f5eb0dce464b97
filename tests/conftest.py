import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from convlytics.session import get_session

    s = get_session("local[4]", 4, app_name="convlytics-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="convlytics-test-ckpt-")})
    yield s
