"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last
return the columns of documents. Empty tables pass through; null and empty texts are kept as clean up to
the mix, which takes words and so has no place for them; repeated rows count as often as they come until
near-duplicates go; very long texts are read whole; other columns may have any names that Parquet can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm import mixing, near_dup, pieces, pii, toxicity
from shelfprice.llm.common import Scratch, numbered
from shelfprice.llm.queries import PIECE_BPE, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 stay; the model is fitted on the labels that are not held out."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of least id stays."""
    return near_dup.keep_one_each(docs, near_dup.near_duplicates(docs, size=5, percent=80))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows the text."""
    plain, at, back = numbered(pii.mask_pii(docs, pii.fit_pii(docs)))
    size = at("n_chars")
    return back(plain.withColumn(size, F.length(at("text")).cast(plain.schema[size].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1: whole documents, left out, once or up to three times, in the order of their shards."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs, block_words=None))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ids of each document of the mix, and digests of the ids and of the text decoded from them."""
    return pieces.round_trip(docs, tokenizer_path(PIECE_BPE)).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "ids", "ids_sha256", "text_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The first stage fits a model: SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written for itself, and its input, go once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, old = list(Scratch.roots), docs
        docs = scratch.keep(stage(spark, old, sf_dir))
        Scratch.remove(spark, [r for r in Scratch.roots if r not in before])
        scratch.drop(old)
    return docs
