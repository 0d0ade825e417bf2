import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from preptrail.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of one column expression over rows of one column ``c``."""

    def run(rows, expr, kind="string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
        return [r[0] for r in df.orderBy("i").select(expr).collect()]

    return run
