import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("kpiframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kpiframe-test-ckpt-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rides(spark):
    """Six bicycle rentals: rider age, tariff, day, a column with a dot in its name, spend, forecast, hours."""
    rows = [
        (19, "day", "2023-05-02", 12, 8.0, 7.0, 2),
        (23, "day", "2023-05-30", 9, 14.0, 15.0, 4),
        (37, "hour", "2023-06-11", 21, 6.0, 6.5, 1),
        (41, "week", "2023-06-12", 7, 50.0, 44.0, 5),
        (58, "hour", "2023-08-01", 15, 3.0, 4.0, 1),
        (64, "week", "2023-08-03", 11, 70.0, 81.0, 7),
    ]
    df = spark.createDataFrame(
        rows, "age int, tariff string, day string, `Load.Kg` int, spend double, forecast double, hours int"
    )
    return df.withColumn("day", F.to_date("day"))


@pytest.fixture(scope="session")
def stations(spark):
    """Seven rentals with places: district, block, point, another district and point, two coordinate pairs."""
    rows = [
        ("NO", "NO 7", "NO 7-1", "D1", "P1", 40.0, 10.0, 41.0, 11.0, 5.0, 2.0),
        ("NO", "NO 7", "NO 7-1", "D1", "P1", 40.5, 10.5, 41.5, 11.5, 7.0, 2.0),
        ("NO", "NO 8", "NO 8-4", "D2", "P2", 40.2, 10.8, 41.2, 11.8, 12.0, 3.0),
        ("SU", "SU 1", "SU 1-1", "D2", "P3", 39.0, 9.0, 38.0, 8.0, 20.0, 4.0),
        ("SU", "SU 2", "SU 2-9", "D3", "P4", 39.5, 9.5, 38.5, 8.5, 30.0, None),
        ("SU", "SU 2", "SU 2-9", "D3", "P4", 39.5, 9.5, 38.5, 8.5, 31.0, 0.0),
        ("  ", None, "XX 0-0", "D4", "P5", -91.0, 9.0, 37.0, 7.0, 44.0, 1.0),
    ]
    return spark.createDataFrame(
        rows,
        "PostcodeArea string, PostcodeSector string, PostcodeUnit string, district string, point string, "
        "lat double, long double, north double, east double, spend double, hours double",
    )

