import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridwarden.session import build_session
    session = build_session(
        "tests", "local[4]", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=4,
        spark__driver__memory="6g",
        spark__checkpoint__dir=tmp_path_factory.mktemp("shared"),
        spark__sql__warehouse__dir=tmp_path_factory.mktemp("warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())
