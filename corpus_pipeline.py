"""From raw documents to token ids: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import byte_cnn, decontamination, line_dedup, near_dedup, pieces
from logloom.llm.queries import piece_model, remainder, table
from logloom.llm.store import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network calls good; labels of held-out rows are not learned from."""
    net = byte_cnn.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return byte_cnn.good_documents(docs, net, 0.3)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its site's boilerplate lines; n_chars follows the text."""
    clean = line_dedup.without_boilerplate(docs)
    size = [F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return clean.select(*size)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8."""
    return near_dedup.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the text decoded from them."""
    made = pieces.encode_texts(docs, piece_model())
    return made.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", boilerplate),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: The learned classifier and the piece encoder have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
