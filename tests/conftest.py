from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorebase.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2, app="lorebase-tests")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a table as sorted tuples of the named columns."""

    def read(df, *columns):
        return sorted(tuple(r[c] for c in columns) for r in df.collect())

    return read
