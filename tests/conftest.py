import pytest

from packetlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=2, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    # Hand-made tables have a few rows: few tasks, and no compilation of every small plan.
    session.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session


def rows_of(df):
    return [r.asDict() for r in df.collect()]
