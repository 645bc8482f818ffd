"""Package folders, listed, read and written by the executors.

A folder tree is a frontier of folders. A task lists the folders it is dealt,
and what it finds below them, up to a number of entries; folders it does not
get to are the next frontier, dealt anew over all tasks. So a wide root and a
deep package both spread, no name reaches the driver, and a task holds no more
than one folder's entries. Then a task reads each file it is dealt and says in
the row itself how that went: a file that is gone, locked or broken costs its
own row and nothing else.

Tasks open the store themselves, so it must be one that workers can reach (a
mounted folder, or an object store or HDFS that Arrow opens). ``reachable``
tries that in a task.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeharvest.session import shuffle_width
from typeharvest.shipping import ship
from typeharvest.storage import stored

#: entries that a task lists for the folders of one batch before it hands the rest on
ENTRIES = 20_000
#: bytes of text in one batch of rows
BATCH_BYTES = 8 << 20

_ENTRY = "rel string, kind string, size long, reason string"
_TEXT = "rel string, content binary, ReadStatus string, ReadError string"


def open_store(root: str) -> tuple[stores.FileSystem, str]:
    """The file system of a root and the path there."""
    if "://" in root and not root.startswith("file:"):
        return stores.FileSystem.from_uri(root)
    return stores.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")


def _children(store: stores.FileSystem, base: str, rel: str) -> list[tuple[str, str, int | None]]:
    """(path below the base, kind, size) of what lies in a folder; a link to a folder is not followed."""
    found = []
    for info in store.get_file_info(stores.FileSelector(f"{base}/{rel}" if rel else base)):
        name = f"{rel}/{info.base_name}" if rel else info.base_name
        if info.type == stores.FileType.Directory:
            linked = isinstance(store, stores.LocalFileSystem) and os.path.islink(info.path)
            found.append((name, "link" if linked else "folder", None))
        elif info.type == stores.FileType.File:
            found.append((name, "file", info.size))
    return found


def reachable(spark: SparkSession, root: str) -> bool:
    """Whether a task can list the root."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                store, path = open_store(root)
                fine = store.get_file_info(path).type == stores.FileType.Directory
            except Exception:  # whatever keeps a worker from the store
                fine = False
            yield pa.record_batch([pa.array([fine] * b.num_rows)], names=["fine"])

    return spark.range(1).mapInArrow(run, "fine boolean").first().fine


def walk(spark: SparkSession, root: str, only_below: str | None = None) -> DataFrame:
    """(rel, kind, size, reason) of all files and folders below the root.

    kind: file, folder, link (to a folder) or failed (a folder that cannot be
    listed, with the reason). ``only_below`` leaves out what lies in other
    folders of a package than this one.
    """
    ship(spark)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for b in batches:
            waiting, left = deque(b.column("rel").to_pylist()), ENTRIES
            while waiting:
                rel, rows = waiting.popleft(), []
                if left <= 0:
                    rows.append((rel, "open", None, None))
                else:
                    try:
                        found = _children(store, base, rel)
                    except Exception as e:  # this folder only
                        found, rows = [], [(rel, "failed", None, f"{type(e).__name__}: {e}")]
                    for name, kind, size in found:
                        if only_below and name.count("/") == 1 and not (kind == "folder" and name.endswith("/" + only_below)):
                            continue
                        rows.append((name, kind, size, None))
                        if kind == "folder":
                            waiting.append(name)
                    left -= len(found) + 1
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rel", "kind", "size", "reason"])

    width = shuffle_width(spark)
    frontier = spark.range(1).select(F.lit("").alias("rel"))
    levels = None
    while True:
        level = stored(frontier.mapInArrow(expand, _ENTRY), "folders")
        listed = level.filter("kind <> 'open'")
        levels = listed if levels is None else levels.unionByName(listed)
        frontier = level.filter("kind = 'open'").select("rel").repartition(width)
        if frontier.isEmpty():
            return levels


def read_texts(names: DataFrame, root: str) -> DataFrame:
    """(rel, content, ReadStatus, ReadError) of files (rel) below the root.

    ReadStatus: ok, empty or failed; a failed file has a null content and the reason.
    """
    spark = names.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rel", "content", "ReadStatus", "ReadError"])

        held, size = [], 0
        for b in batches:
            for rel in b.column("rel").to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{rel}") as f:
                        content = f.read()
                    held.append((rel, content, "ok" if content else "empty", None))
                    size += len(content)
                except Exception as e:  # this file only
                    held.append((rel, None, "failed", f"{type(e).__name__}: {e}"))
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return names.select("rel").repartition(shuffle_width(spark)).mapInArrow(run, _TEXT)


def write_texts(files: DataFrame, root: str) -> DataFrame:
    """Writes files (rel, text) below the root, which tasks must reach; (rel) of each written.

    A task makes the folders and files it is dealt. A repeated task writes the same
    files again, so each rel may stand in one row only.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for b in batches:
            for rel, text in zip(b.column("rel").to_pylist(), b.column("text").to_pylist()):
                path = f"{base}/{rel}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(text.encode())
            yield b.select(["rel"])

    dealt = files.select("rel", "text").repartition(shuffle_width(files.sparkSession), "rel")
    return dealt.mapInArrow(run, "rel string")
