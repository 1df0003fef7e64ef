import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    work = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
           "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.checkpoint.dir": f"file://{work}/shared"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
