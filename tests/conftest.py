import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Rows of a result as dictionaries, by the value of one column."""

    def by(df, key="column"):
        return {row[key]: row.asDict() for row in df.collect()}

    return by
