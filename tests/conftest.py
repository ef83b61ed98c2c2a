import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rollbook.session import tuned_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tuned_session(
        "local[8]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame from column names and rows, all text unless a schema is given."""

    def make(columns, rows, schema=None, partitions=None):
        schema = schema or ", ".join(f"`{c}` string" for c in columns)
        df = spark.createDataFrame([tuple(r) for r in rows], schema)
        return df.repartition(partitions) if partitions else df

    return make
