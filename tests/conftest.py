import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelyard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, shuffle_partitions=4, memory="6g")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("CERT string, X double", [rows]) with yyyy-MM-dd texts turned into dates."""
    import datetime

    def build(schema, rows):
        names = [part.strip().split() for part in schema.split(",")]
        days = [i for i, (_, kind) in enumerate(names) if kind == "date"]
        fixed = [tuple(datetime.date.fromisoformat(v) if i in days and isinstance(v, str) else v
                       for i, v in enumerate(row)) for row in rows]
        return spark.createDataFrame(fixed, schema)

    return build


def by(df, *keys):
    """Rows of a frame as a dict keyed by some columns."""
    rows = {}
    for r in df.collect():
        key = tuple(str(r[k]) for k in keys)
        rows[key[0] if len(key) == 1 else key] = r
    return rows
