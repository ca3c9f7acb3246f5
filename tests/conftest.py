"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievekit.session import session

    where = tmp_path_factory.mktemp("shared")
    made = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=f"file://{where}",
        spark__sql__warehouse__dir=f"file://{where}/warehouse",
        spark__driver__memory="4g",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
