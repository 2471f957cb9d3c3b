import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidelag.session import build_session

    s = build_session("tests", "local[4]", 4, spark_ui_enabled="false", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
