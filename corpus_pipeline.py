"""The corpus pipeline: STAGES over documents, each one's rows written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import store, table
from strandline.llm.decontaminate import clean_documents
from strandline.llm.jaccard_join import jaccard_components
from strandline.llm.line_dedup import dedup_lines
from strandline.llm.quality import good_documents
from strandline.llm.word_bpe import decode_documents, digests, encode_documents


def _keep(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or isn't (left_anti) in ids, a table of one column; null equals null."""
    name = "kept_id"
    while name in docs.columns:
        name += "_"
    ids = ids.toDF(name).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(name)), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents hold; n_chars follows the text where it has lost any, null texts stay null."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    marked = docs.select("doc_id", "text", others.alias("others"), F.col("text").isNull().alias("no_text"))
    found = dedup_lines(marked, carry=("others", "no_text"))
    lost, before = F.col("n_dropped") > 0, lambda c: F.col("carried")["others"][c]
    values = {"text": F.when(~F.col("carried")["no_text"], F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(lost, F.char_length("text").cast("long")).otherwise(before("n_chars"))
    return found.select(*((values[c] if c in values else before(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest doc_id stays; rows without doc_id stay.

    Rows of one doc_id are one document here: they go if none of them is the smallest of its component.
    """
    found = jaccard_components(docs).groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("goes")).where("goes")
    return _keep(docs, found.select("doc_id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a test item go, each row by its own text."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(decode_documents(encode_documents(docs, path), path))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
