import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()  # pytest clears its own temporary folders


@pytest.fixture(scope="session")
def five(spark):
    """Five orders with known totals."""
    return spark.createDataFrame(
        [
            ("O1", "C1", "2025-01-01", 100.0, 1, "Electronics"),
            ("O2", "C2", "2025-01-02", 250.0, 2, "Clothing"),
            ("O3", "C1", "2025-01-03", 150.0, 1, "Electronics"),
            ("O4", "C3", "2025-01-04", 500.0, 4, "Books"),
            ("O5", "C2", "2025-01-05", 300.0, 3, "Clothing"),
        ],
        "order_id string, customer_id string, order_date string, revenue double, quantity int, product_category string",
    )
