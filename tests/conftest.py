import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", "6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression over rows, in order."""
    def run(rows, schema, column):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id int, {schema}")
        got = df.select("row_id", column.alias("value")).collect()
        return [r["value"] for r in sorted(got, key=lambda r: r["row_id"])]

    return run
