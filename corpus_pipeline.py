"""A corpus pipeline of five operators; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from riskgrain.llm.common import free_name, settle, table
from riskgrain.llm.queries import tokenizer_json


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this input's labelled ones, accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.ACCEPTED).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that similar earlier ones make redundant; those left without any line go."""
    removed = free_name(docs, "n_removed")
    clean = line_dedup.dedup_lines(docs, removed=removed)
    clean = clean.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.where((F.col(removed) == 0) | (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0)).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones: five-word shingles, similarity 0.8."""
    return ngram_join.one_of_each(docs, size=5, share=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    done = bpe.encode_decode(docs, tokenizer_json(), block_bytes=ENCODE_BLOCK_BYTES)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Bytes of text in one block of encoding: smaller than alone, as the workers' and the JVM's memory is what earlier stages left.
ENCODE_BLOCK_BYTES = 2 << 20

STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
