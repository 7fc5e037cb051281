"""Line dedup: drop lines that many documents hold, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER


#: Keys whose rows are dealt out, and over how many salts.
HOT, SALTS = 1000, 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and text, the lines that stay; carried, a struct of the columns in carry.

    Every line has a key: the line without ASCII white space at its ends and with A-Z in lower case.  Keys are hashed
    (128 bits), and the documents of each hash are counted.  A key of at least min_chars code points that at least
    min_docs documents hold loses all its lines, but for those in the largest doc_id that holds it; the others are put
    together again by position.

    Null and empty texts are one empty line.  Rows of one doc_id count as one document, and each is a row of the
    result.  Rows without doc_id don't count as documents; they lose the lines that others lose.  Only doc_id and text
    are read, so that other columns may have any name.  An empty table gives an empty result.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select("doc_id", split.alias("lines"), *([F.struct(*carry).alias("carried")] if carry else []))
    long_keys = F.filter(F.transform("lines", line_key), lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(long_keys, F.md5))
    held = rows.select("doc_id", F.explode(hashes).alias("hash")).distinct()
    frequent = held.groupBy("hash").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # rows of the most frequent keys are dealt out by document; any other key has less than one in HOT of all rows
    hot = F.broadcast(frequent.orderBy(F.desc("n"), "hash").limit(HOT).select(F.col("hash").alias("hot")))
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("long")
    every = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    is_hot = F.col("hash") == F.col("hot")
    keepers = frequent.join(hot, is_hot, "left").select("hash", "keeper", F.explode(every.cast("array<long>")).alias("salt"))
    lost = (
        held.join(hot, is_hot, "left").select("doc_id", "hash", salt.alias("salt")).join(keepers, ["hash", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_list("hash").alias("lost"))
        .withColumnRenamed("doc_id", "lost_id")
    )
    with_lost = rows.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("lost_id")), "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains("lost", F.md5(key))

    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    more = ["carried"] if carry else []
    return with_lost.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"), *more).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"), *more
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> keeper AS lost
  FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
