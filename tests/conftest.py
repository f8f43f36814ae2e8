import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="docspark-tests-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")  # tables are tiny: compiling takes longer than they do
        .config("spark.sql.parquet.compression.codec", "uncompressed").config("spark.sql.warehouse.dir", os.path.join(shared, "warehouse")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
