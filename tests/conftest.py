import pytest

from deedscope.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
        checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")),
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
