"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, released, salted_join, small_batches, store, table
from .encoders import encoder

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an empty table where nothing has been stored yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and digest, without special tokens of the tokenizer's own.

    Content is normalised (runs of ASCII white space become one blank, which this vocabulary drops anyway) and hashed;
    the tokenizer's version is the hash of its file.  Both digests are joined with the cache, only one text of each
    digest that it lacks is encoded, and the new counts are appended to it.  Digests that a lost task had appended
    twice count once.  The cache is a table at cache_path; without one, a new one in the shared folder.

    Null texts are empty and have no tokens.  Null, repeated or tied doc_ids are rows like others.  Only doc_id and
    text are read, so that other columns may have any name.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    normal = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ").alias("normal"))
    digested = normal.withColumn("digest", F.sha2("normal", 256))
    keyed = store(digested.select("doc_id", "n_bytes", "digest"), "token-digests")

    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest").distinct()
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("one_id")).join(known, "digest", "left_anti")
    misses = misses.withColumnRenamed("digest", "miss").hint("shuffle_hash")
    texts = digested.join(misses, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("digest", "normal")

    small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = encoder(tokenizer_path, "word").counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    counted = texts.mapInArrow(released(count), "digest string, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    counted.write.mode("append").parquet(cache_path)

    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return salted_join(keyed, counts, "digest", "doc_id").select("doc_id", "n_bytes", "n_tokens", "digest")


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
