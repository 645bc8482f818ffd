"""Helpers of the operators: shared folders, written tables, rolling byte hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401  (of all operators)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only where the cluster names none (local tests) a temporary one is made."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        own = spark.sparkContext.applicationId
        found = _LOCAL.get(own) or _LOCAL.setdefault(own, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when the action ends; what it wrote stays."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


_SEGMENT, _GAP = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")


def segments(data: bytes, size: int = _SEGMENT) -> Iterator[bytes]:
    """The data in order, in parts of about `size` bytes that end before white space: no word is cut, no list holds all words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- rolling hashes of byte strings -------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 1 << 22:
            return have
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class RollingHash:
    """Hashes of any substring of a byte string in constant time each (polynomial over 2**64 on random byte codes)."""

    def __init__(self, data: bytes) -> None:
        a = np.frombuffer(data, dtype=np.uint8)
        self.n = len(a)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[a] * _powers(_BASE, self.n), out=self.sums[1:])
        self.inverse = _powers(_BASE_INVERSE, self.n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The unmixed hash of each substring."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, k: int) -> np.ndarray:
        """The hash of each substring of k bytes, by its start."""
        if self.n < k:
            return np.empty(0, dtype=np.uint64)
        return (self.sums[k:] - self.sums[: self.n + 1 - k]) * self.inverse[: self.n + 1 - k]
