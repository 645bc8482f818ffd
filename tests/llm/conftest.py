import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='shared-')}",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", conf["spark.checkpoint.dir"])
    return session


@pytest.fixture
def frame(spark):
    """A documents table of (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", score double, kept string, sequence_id long")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
