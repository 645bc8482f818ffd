"""Folder trees listed and read by tasks: empty, locked, deleted, linked and many files; the driver sees no name."""

import os

import pytest

from typeharvest.plans import jobs
from typeharvest.sources import folders, readers, writers


def _write(root, rel, text="x::Int = 1\n"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "some pkgs+%20")
    for rel in ("A.jl/src/a.jl", "A.jl/src/deep/er/b.jl", "A.jl/test/t.jl", "B b.jl/src/ä ö.jl", "C/x.txt", "top.jl", "D/src.jl", "A.jl/srcs/no.jl"):
        _write(root, rel)
    _write(root, "A.jl/src/empty.jl", "")
    _write(root, "A.jl/src/bytes.jl", b"f(x::Q) = \"\xff\xfe\"\n")
    os.makedirs(f"{root}/E/src")
    os.makedirs(f"{root}/F")
    os.symlink(root, f"{root}/A.jl/src/loop")
    os.symlink(f"{root}/nowhere", f"{root}/A.jl/src/dangling.jl")
    return root


ALL = {
    ("A.jl", "src/a.jl", "ok"), ("A.jl", "src/deep/er/b.jl", "ok"), ("A.jl", "test/t.jl", "ok"), ("B b.jl", "src/ä ö.jl", "ok"),
    ("D", "src.jl", "ok"), ("A.jl", "srcs/no.jl", "ok"), ("A.jl", "src/empty.jl", "empty"), ("A.jl", "src/bytes.jl", "ok"),
}


def rows(df):
    return {(r.Package, r.File, r.ReadStatus) for r in df.select("Package", "File", "ReadStatus").collect()}


@pytest.mark.parametrize("entries", [20_000, 1])
def test_walks_the_whole_tree(spark, tree, monkeypatch, entries):
    monkeypatch.setattr(folders, "ENTRIES", entries)  # 1: every folder waits for a round of its own
    assert rows(readers.code_files(spark, tree)) == ALL
    assert rows(readers.code_files(spark, tree, src_only=True)) == {r for r in ALL if r[1].startswith("src/")}
    dirs = {r.Package: r.hasSrc for r in readers.package_dirs(spark, tree).collect()}
    assert dirs == {"A.jl": True, "B b.jl": True, "C": False, "D": False, "E": True, "F": False}


def test_spark_reader_gives_the_same_rows(spark, tree, monkeypatch):
    os.unlink(f"{tree}/A.jl/src/loop")  # Spark's index follows links
    own = rows(readers.code_files(spark, tree))
    monkeypatch.setattr(folders, "reachable", lambda *_: False)
    assert rows(readers.code_files(spark, tree)) == own == ALL
    assert {r.Package: r.hasSrc for r in readers.package_dirs(spark, tree).collect()} == {"A.jl": True, "B b.jl": True, "C": False, "D": False, "E": True, "F": False}


def test_files_that_go_or_cannot_be_read_cost_their_own_row(spark, tree, monkeypatch):
    files = readers.code_files(spark, tree)  # listed; read below
    os.unlink(f"{tree}/A.jl/src/a.jl")
    os.unlink(f"{tree}/A.jl/test/t.jl")
    os.makedirs(f"{tree}/A.jl/test/t.jl")  # a folder by now
    got = {r.File: r for r in files.collect()}
    assert len(got) == len(ALL)
    failed = {f for f, r in got.items() if r.ReadStatus == "failed"}
    assert failed == {"src/a.jl", "test/t.jl"} and all(got[f].text is None and got[f].ReadError for f in failed)
    assert got["src/bytes.jl"].text == "f(x::Q) = \"\ufffd\ufffd\"\n"
    assert got["src/empty.jl"].text == "" and got["src/empty.jl"].ReadError is None
    os.rmdir(f"{tree}/A.jl/test/t.jl")


def test_unlisted_folder_is_a_row(spark, tree, monkeypatch):
    whole = folders._children

    def refuse(store, base, rel):
        if rel == "A.jl/src/deep":
            raise PermissionError("locked")
        return whole(store, base, rel)

    monkeypatch.setattr(folders, "_children", refuse)  # the task's closure takes it along
    found = {(r.rel, r.kind, r.reason) for r in folders.walk(spark, readers.qualified(spark, tree)).collect()}
    assert ("A.jl/src/deep", "failed", "PermissionError: locked") in found and ("A.jl/src/a.jl", "file", None) in found
    assert not any(rel.startswith("A.jl/src/deep/") for rel, _, _ in found)
    assert rows(readers.code_files(spark, tree)) == {r for r in ALL if "deep" not in r[1]}


def test_extract_job_records_lost_files(spark, tree, tmp_path, monkeypatch):
    read = folders.read_texts

    def later(names, root):
        if os.path.exists(f"{tree}/A.jl/src/a.jl"):
            os.unlink(f"{tree}/A.jl/src/a.jl")
        return read(names, root)

    monkeypatch.setattr(folders, "read_texts", later)
    log = {(r.Package, r.File): r.status for r in jobs.extract_job(spark, tree, str(tmp_path / "out")).collect()}
    assert log["A.jl", "src/a.jl"] == "fail" and log["A.jl", "src/empty.jl"] == "succ" and log["B b.jl", "src/ä ö.jl"] == "succ"


def test_empty_root(spark, tmp_path):
    assert readers.code_files(spark, str(tmp_path)).collect() == []
    assert readers.package_dirs(spark, str(tmp_path)).collect() == []


def test_folders_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """One file a folder, as Spark's writer lays folders out; it is only asked where tasks cannot open the store."""
    rows = spark.createDataFrame([("a", "src", "x"), ("a", "src", "x"), ("a", "doc", "y"), ("b", "doc", "x"), (None, "src", "x")], "P string, S string, value string")

    def laid(root):
        return {(os.path.relpath(at, root), open(os.path.join(at, n)).read()) for at, _, names in os.walk(root) for n in names if n.endswith(".txt")}

    own, by_spark = str(tmp_path / "own"), str(tmp_path / "spark")
    writers.write_folders(rows, own, ["P", "S"])
    assert not any(n.endswith(".crc") or n == "_SUCCESS" for _, _, names in os.walk(own) for n in names)
    monkeypatch.setattr(folders, "reachable", lambda *a: False)
    writers.write_folders(rows, by_spark, ["P", "S"])
    assert laid(own) == laid(by_spark) and len(laid(own)) == 4
    writers.write_folders(rows.limit(0), str(tmp_path / "none"), ["P", "S"])
    monkeypatch.undo()
    assert readers.package_dirs(spark, str(tmp_path / "none"), "S=src").count() == 0
