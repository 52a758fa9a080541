import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendgap.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests",
        **{
            "spark.checkpoint.dir": str(shared),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    """Table names in a database of their own, dropped afterwards."""
    import uuid

    from trendgap.config import TableNames

    names = TableNames(database=f"t{uuid.uuid4().hex}")
    yield names
    spark.sql(f"DROP DATABASE IF EXISTS {names.database} CASCADE")


def values(df, *columns):
    """Collected rows as plain tuples, in the order of the frame."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
