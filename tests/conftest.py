import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stoplake.session import local_session

    return local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('scratch')}"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
