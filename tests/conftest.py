import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from minutary.session import build_session  # noqa: E402
from turn_rows import TURN, at  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.tables(SF)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make_turns(spark):
    """Turns from (meeting, turn, speaker, text[, start[, end]])."""

    def make(*rows):
        full = [(*row, *[None] * (6 - len(row))) for row in rows]
        clocked = [(*row[:4], *[at(x) if x else None for x in row[4:]]) for row in full]
        return spark.createDataFrame(clocked, TURN)

    return make


@pytest.fixture
def rows():
    """Sorted plain tuples of some columns."""

    def read(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(row) for row in picked.collect()), key=repr)

    return read
