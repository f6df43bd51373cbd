import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loopledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan_rows(spark):
    """Scan many small sources in one job: name -> (language, error, findings)."""
    from loopledger import scan

    def run(cases, **options):
        df = spark.createDataFrame(
            [(name, *case) for name, case in cases.items()],
            "name string, path string, code string, declared_language string",
        )
        return {r["name"]: r for r in scan(df, **options).collect()}

    return run
