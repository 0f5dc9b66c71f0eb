import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scales import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="binlens-test-", dir="/tmp")
    s = (SparkSession.builder.master("local[*]").appName("binlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from binlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from binlens.testing import duckdb_connection
    return duckdb_connection(SF_SMALL)


@pytest.fixture(scope="session")
def duck_oracle():
    from binlens.testing import duckdb_connection
    return duckdb_connection(SF_ORACLE)
