"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens) in the shared folder. Texts are normalised in
a way that leaves the count unchanged, digested, and joined to the stored counts of the same tokenizer version; each
distinct text without one is encoded once, and its count is appended.

Null texts count as empty. Repeated rows share a digest and keep a row each. Columns other than ``doc_id`` and ``text``
are left aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.textbuf import chunks
from trajspark.llm.tokens import by_words, count_texts, tokenizer_digest, word_ids
from trajspark.session import shared_dir

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def _encode(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    whole = None if by_words(path) else count_texts
    for b in batches:
        counts: list[int] = []
        if whole:
            counts = whole(path, [t or "" for t in b.column(1).to_pylist()])
        else:
            store = word_ids(path)
            for _, _, data, offsets in chunks(b.column(1)):
                counts += store.counts(data, offsets).tolist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
            ["content", "tokenizer", "n_tokens"],
        )


class TokenCountCache:
    """Counts kept between calls. ``path``: a folder that driver and executors share; by default a new one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/trajspark/token-counts-{uuid.uuid4().hex}"

    def _stored(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)

    def count(self, docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
        """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``."""
        version = tokenizer_digest(tokenizer)
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        # white space is dropped by such a tokenizer, so runs of blanks and line ends are all one
        same = F.trim(F.regexp_replace(text, "[ \n]+", " ")) if by_words(tokenizer) else text
        keyed = docs.select(F.col("doc_id"), same.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        keyed = keyed.withColumn("content", F.unhex(F.sha2("text", 256)))
        known = self._stored().where(F.col("tokenizer") == version).dropDuplicates(["content"])
        missing = keyed.select("content", "text").join(known, "content", "left_anti")
        # one text of each digest: copies within a task go before the shuffle
        missing = missing.groupBy("content").agg(F.first("text").alias("text"))
        encoded = missing.mapInArrow(lambda batches: _encode(batches, tokenizer, version), CACHE_SCHEMA)
        encoded.write.mode("append").parquet(self.path)
        counts = self._stored().where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        return keyed.select("doc_id", "n_bytes", "content").join(counts, "content").select(
            "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
        )
