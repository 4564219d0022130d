import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [p for p in (str(ROOT), str(ROOT / "tests")) if p not in sys.path]


@pytest.fixture(scope="session")
def spark():
    from timeloom.session import build_session

    s = build_session("tests", cores=4, shuffle_partitions=4, **{"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
