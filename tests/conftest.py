import tempfile

import pytest

from keytempo.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "keytempo-tests", "local[8]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="keytempo-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, digits=6):
    """All rows as sorted tuples with rounded doubles."""
    def value(x):
        return round(x, digits) + 0.0 if isinstance(x, float) else x

    names = sorted(df.columns)
    found = [tuple(value(r[n]) for n in names) for r in df.collect()]
    return sorted(found, key=repr)
