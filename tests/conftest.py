import pytest
from pyspark.sql import SparkSession

from tallyworks.session import build_session
from tallyworks.storage import Workspace


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = build_session(
        "tallyworks-tests",
        "local[4]",
        {
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    Workspace.of(session).close()
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """Write a text file below the test's own folder and return its path."""

    def write(name: str, content: str) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8", newline="")
        return str(path)

    return write
