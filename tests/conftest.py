import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ramplake.config import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks so small that every series crosses many of them."""
    from ramplake.operators import chunks, detect, folds, timegrid

    for module in (chunks, detect, folds, timegrid):
        monkeypatch.setattr(module, "CHUNK", 16)
