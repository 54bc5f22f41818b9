import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("carepulse-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="carepulse-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="carepulse-test-")


def bronze_row(**cells):
    """A bronze row (all text) with sensible defaults; override cells by raw name."""
    from carepulse.contracts import BRONZE_COLUMNS

    base = {c: "10" for c in BRONZE_COLUMNS}
    base.update(
        PRVDR_ID="000123",
        PRVDR_NAME="Alpha Care",
        PRVDR_CITY="Springfield",
        PRVDR_ZIP="01234",
        STATE="MA",
        SRVC_CTGRY="SNF",
        SMRY_CTGRY="PROVIDER",
        YEAR_TYPE="CY",
        YEAR="2023",
        BENE_AVG_RISK_SCRE="2.0",
        BENE_DUAL_PCT="30",
        BENE_RRL_PCT="10",
    )
    base.update(cells)
    return base


def bronze_df(spark, rows):
    from carepulse.contracts import BRONZE_COLUMNS, bronze_schema

    return spark.createDataFrame([tuple(r[c] for c in BRONZE_COLUMNS) for r in rows], bronze_schema())
