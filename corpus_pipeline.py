"""The corpus pipeline: quality, repeated lines, near copies, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Every stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import byte_bpe, decontam, line_dedup, quality_qda, simhash
from isohyet.llm._common import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go.

    Null and empty texts have a score like any other (statistics of no words);
    rows with null or repeated ids are scored one by one; without labels, or with
    labels of one class, the model still gives every text a score. An empty table
    stays empty; other columns are carried, whatever their names.
    """
    return quality_qda.quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in five documents or more stay in the one of the largest id; n_chars follows the text.

    A null text becomes an empty one (one empty line); rows of one id, also of
    the null id, are one document, and null is the smallest id. Repeated rows are
    all kept, with the same text; an empty table stays empty; other columns are
    carried, whatever their names.
    """
    kept = {"n_lines", "n_dropped"}
    clash = {c: f"{c}__kept" for c in docs.columns if c.lower() in kept}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(clash)).drop(*kept).withColumnsRenamed({v: k for k, v in clash.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    Null and empty texts hold the same (no) words and are copies of each other;
    texts below five words are one shingle. Repeated rows are one document and
    stay or go together; rows with a null id stay. An empty table stays empty;
    other columns are carried, whatever their names.
    """
    return simhash.simhash_dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay; repeated rows go or stay
    together; rows with a null id are told apart by their texts. An empty table or
    benchmark takes nothing away; other columns are carried, whatever their names.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document that is left, with the digests of ids and decoded bytes.

    A null or empty text has no ids; repeated rows and null ids are encoded row by
    row; an empty table stays empty. Only doc_id and text are read.
    """
    out = byte_bpe.byte_bpe(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: No SQL: the classifier, SimHash components and BPE aren't expressible; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
