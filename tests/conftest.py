import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    s = local_session(4, "4g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoints')}")
    yield s
    s.stop()
