import pytest

from fintrail.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                          "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
