"""Sources: package folders, stored tables, package lists and logs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from typeharvest.functions import printed
from typeharvest.sources import folders, schemas
from typeharvest.sources.lines import PLACE, numbered, text_lines

SUFFIX, SRC = ".jl", "src"


def qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark writes it in the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _under(root: str, path: Column) -> Column:
    """Path below the qualified ``root``; a path elsewhere ends the job."""
    base = root.rstrip("/") + "/"
    if base.startswith("file:"):  # written with one slash or three
        base = "file:/" + base[len("file:"):].lstrip("/")
        path = F.regexp_replace(path, "^file:/+", "file:/")
    below = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(base)), below).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {base}: "), path)).cast("string"))


def _decoded(path: Column) -> Column:
    """A percent-encoded path as it was; a plus sign is itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def code_files(spark: SparkSession, root: str, src_only: bool = False, suffix: str = SUFFIX) -> DataFrame:
    """(Package, File, text, ReadStatus, ReadError) of every source file below
    ``root``/<package>/.

    ``src_only`` keeps files under the package's ``src`` folder. Every listed
    file is a row. ReadStatus: ok, empty (an empty text) or failed (a null
    text, and the reason). Executors list and read; only where their workers
    cannot open the store does Spark's own file index, on the driver.
    """
    below = qualified(spark, root)
    if folders.reachable(spark, below):
        found = folders.walk(spark, below, SRC if src_only else None)
        names = found.filter((F.col("kind") == "file") & F.col("rel").endswith(suffix))
        raw = folders.read_texts(names.filter(F.col("rel").contains("/")), below)
    else:
        raw = _indexed(spark, root, below, suffix)
    df = raw.filter(F.col("rel").contains("/")).select(
        F.substring_index("rel", "/", 1).alias("Package"),
        F.expr("substring(rel, instr(rel, '/') + 1)").alias("File"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),  # other bytes become U+FFFD
        "ReadStatus", "ReadError")
    return df.filter(F.col("File").startswith(SRC + "/")) if src_only else df


def _indexed(spark: SparkSession, root: str, below: str, suffix: str) -> DataFrame:
    """Files by Spark's own reader. It gives no row for an empty or unreadable
    file: those are what its index lists beyond, told apart by their length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
    reader = files.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    raw = reader.select(_under(below, F.col("path")).alias("rel"), "content")
    listed = spark.createDataFrame([(p,) for p in reader.inputFiles()], "path string").select(
        _under(below, _decoded(F.col("path"))).alias("rel"))
    store = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def length(rel: str) -> int:
        try:
            return store.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{rel}")).getLen()
        except Py4JJavaError:  # gone since
            return -1

    rest = [(r.rel, length(r.rel)) for r in listed.join(raw.select("rel"), "rel", "left_anti").toLocalIterator()]
    rest = spark.createDataFrame([(rel, b"" if n == 0 else None) for rel, n in rest], "rel string, content binary")
    status = F.when(F.col("content").isNull(), "failed").when(F.length("content") == 0, "empty").otherwise("ok")
    return raw.unionByName(rest).withColumns({
        "ReadStatus": status, "ReadError": F.when(F.col("content").isNull(), F.lit("not readable"))})


def package_dirs(spark: SparkSession, root: str, src: str = SRC) -> DataFrame:
    """(Package, hasSrc): the folders below ``root``, and whether they have a folder ``src``."""
    below = qualified(spark, root)
    if folders.reachable(spark, below):
        found = folders.walk(spark, below, src).filter("kind in ('folder', 'failed', 'link')").select(
            F.split("rel", "/").alias("parts")).filter(F.col("parts")[0] != "")
        return found.groupBy(F.col("parts")[0].alias("Package")).agg(
            F.bool_or(F.coalesce(F.get("parts", F.lit(1)) == src, F.lit(False))).alias("hasSrc"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    is_dir = lambda *names: store.exists(p := spark._jvm.org.apache.hadoop.fs.Path(*names)) and store.getFileStatus(p).isDirectory()
    rows = [(s.getPath().getName(), is_dir(s.getPath(), src)) for s in store.listStatus(path) if s.isDirectory()]
    return spark.createDataFrame(rows, "Package string, hasSrc boolean")


def _records(spark: SparkSession, root: str, schema: StructType, file_name: str) -> tuple[DataFrame, DataFrame]:
    """(all lines, their records): Package, place, the fields or what is wrong; headers left out."""
    lines = text_lines(spark, root, file_name)
    rel = _under(qualified(spark, root), _decoded(F.col("file")))
    folder = F.substring_index(rel, "/", 1)
    # folders of the own writer carry the column's name and escape some characters
    package = F.when(folder.startswith("Package="), _decoded(F.substring(folder, len("Package=") + 1, 1 << 20))).otherwise(folder)
    names = schema.names
    headers = [",".join(names), ",".join(f'"{n}"' for n in names)]
    fields, wrong = printed.parsed(F.col("value"), len(names))
    rows = lines.filter(~F.col("value").isin(headers) & (F.col("value") != ""))
    return lines, rows.select(*PLACE, package.alias("Package"), "value", fields.alias("fields"), wrong.alias("kind"))


def stored_table(spark: SparkSession, root: str, schema: StructType, file_name: str) -> DataFrame:
    """All <package>/<file_name> CSVs below ``root`` with their Package.

    A record is a line of printed fields, so files are read in blocks. What is
    no such line is in ``stored_errors``.
    """
    records = _records(spark, root, schema, file_name)[1].filter("kind is null")
    return records.select("Package", *[F.col("fields")[i].alias(n) for i, n in enumerate(schema.names)])


def stored_errors(spark: SparkSession, root: str, schema: StructType, file_name: str) -> DataFrame:
    """(Package, file, record, kind, value) of each line that is no record: its
    number in the file (the header is 0) and what is wrong with it."""
    lines, records = _records(spark, root, schema, file_name)
    return numbered(lines, records.filter("kind is not null")).select(
        "Package", "file", F.col("line").alias("record"), "kind", "value")


def type_annotations(spark: SparkSession, root: str, file_name: str = "type-annotations.csv") -> DataFrame:
    return stored_table(spark, root, schemas.TYPE_ANNOTATIONS, file_name)


def type_declarations(spark: SparkSession, root: str, file_name: str = "type-declarations.csv") -> DataFrame:
    return stored_table(spark, root, schemas.TYPE_DECLARATIONS, file_name)


def bad_packages(packages: DataFrame, table: DataFrame) -> DataFrame:
    """Listed packages without a stored table."""
    return packages.join(table.select("Package").distinct(), "Package", "left_anti")


def package_list(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """name, uuid, version and the line number, in list order; or the first N.

    Several lists, or the parts of one, are taken in the order of their names.
    Empty lines count as lines, but not as packages. Of the first N, a task
    passes on no more than N.
    """
    lines = text_lines(spark, path)
    wanted = lines.filter("value <> ''")
    if first is not None:
        wanted = wanted.orderBy(*PLACE).limit(first)
    fields = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.PACKAGE_LIST.fields))
    found = numbered(lines, wanted).select(*PLACE, fields.alias("f"), "line")
    return found.orderBy(*PLACE).select("f.*", "line")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)

