"""A corpus pipeline: documents are filtered, near-duplicates removed, secrets masked, and the rest packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import jaccard_join, packing, secret_scan, toxicity
from mediaframe.llm.common import saved
from mediaframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored 0.5 or more; labels of sf_dir train the model. Null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that with the smallest doc_id, then the first."""
    return jaccard_join.representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every reported secret masked in text, and n_chars, where there is such a column and a value, as the new text has them."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    return packing.pack(packing.cut(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("secret_scan", mask_secrets), ("best_fit_packing", pack_sequences)]
#: A trained classifier can't be put in SQL; a test holds run(), with labels of which none is toxic, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
