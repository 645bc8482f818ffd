"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
#: temporary folders of local sessions, by application
_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; one is made only for local sessions that name none."""
    root = spark.conf.get(SHARED, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        own = spark.sparkContext.applicationId
        root = _LOCAL.get(own) or _LOCAL.setdefault(own, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table of their own: worked out once, whatever reads them, and kept when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
