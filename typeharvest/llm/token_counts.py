"""Token counts through a cache of digests.

A text is known by its sha256 and the digest of the tokenizer's file and library version. Counts are looked up in a
stored table; only distinct texts that it lacks are encoded, and their counts are appended. Digests shuffle, and each
missing text once; a text that holds a third of the rows is one digest after partial aggregation.

Null text: empty. Null and repeated ids: each row gets its count (a row repeated with its id may be encoded again). An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenization
from .common import scratch, ship, whole_text, written

_CACHE = "version string, digest binary, n_tokens long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_bytes, digest) of each row; the normalised content is the text's UTF-8 bytes, for any other normalisation could change the count."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def cached_counts(docs: DataFrame, tokenizer: str, cache_dir: str) -> DataFrame:
    """The stored counts of this tokenizer's version; none if the folder does not exist yet."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    table = spark.read.schema(_CACHE).parquet(cache_dir) if exists else spark.createDataFrame([], _CACHE)
    # a job that ran twice may have stored a digest twice
    return table.where(F.col("version") == tokenization.version_of(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(keyed: DataFrame, tokenizer: str, cache_dir: str) -> None:
    """Appends the counts of the distinct texts that the cache lacks."""
    version = tokenization.version_of(tokenizer)
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = first.join(cached_counts(keyed, tokenizer, cache_dir), "digest", "left_anti").withColumnRenamed("digest", "miss").hint("shuffle_hash")
    # one row of each text shuffles to nobody: the id is part of the key, so copies do not meet in one task
    texts = keyed.join(misses, (keyed.digest == misses.miss) & keyed.doc_id.eqNullSafe(misses.first_id), "left_semi").select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenization.load(tokenizer).count
        for b in batches:
            yield pa.record_batch([pa.array([version] * b.num_rows, pa.string()), b.column("digest"), pa.array([count(t.as_py()) for t in b.column("text")], pa.int64())], names=["version", "digest", "n_tokens"])

    texts.mapInArrow(encode, _CACHE).write.mode("append").parquet(cache_dir)


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row. cache_dir: the stored table, in a folder that all executors share; None starts a new one."""
    ship(docs.sparkSession)
    cache_dir = cache_dir or scratch(docs.sparkSession, "token-cache")
    keyed = digests(docs, id_col, text_col)
    encode_misses(keyed, tokenizer, cache_dir)
    # written, so that the join's sides are plain shuffles, which Spark splits where a digest is hot
    counts = written(cached_counts(docs, tokenizer, cache_dir), "token-counts")
    return keyed.drop("text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
