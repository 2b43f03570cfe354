from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from poolsight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session("local[8]", 4, **{"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


@pytest.fixture
def cloud(spark):
    """A small point cloud from a list of states (and other columns) in one layer."""

    def build(states, layer=30, session="s", state="state0", **columns):
        n = len(states)
        names = [state, *columns]
        rows = [
            (session, "c", "j", None, layer, i, *values)
            for i, values in enumerate(zip(states, *[columns[c] for c in columns]))
        ]
        types = ["int"] + ["double"] * len(columns)
        schema = "session string, config string, job string, subfolder int, layer int, idx long, " + ", ".join(
            f"{c} {t}" for c, t in zip(names, types)
        )
        assert len(rows) == n
        return spark.createDataFrame(rows, schema)

    return build
