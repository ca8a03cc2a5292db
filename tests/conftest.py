import pytest

from tickerpulse.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tickerpulse-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain tuples in a stated order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
