import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from coldwatch.schemas import telemetry_schema  # noqa: E402
from coldwatch.session import local_session  # noqa: E402
from coldwatch.sources.events import read_telemetry  # noqa: E402

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def telemetry(spark):
    return read_telemetry(spark, SF)


@pytest.fixture
def readings(spark):
    """Builds a telemetry DataFrame from partial records."""

    def build(*records: dict):
        schema = telemetry_schema()
        rows = [
            tuple({"event_id": i, **r}.get(name) for name in schema.names)
            for i, r in enumerate(records)
        ]
        return spark.createDataFrame(rows, schema)

    return build
