"""A training corpus from the documents: without toxic texts and near duplicates, mixed by source, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm.bpe import encode_and_decode
from skein.llm.jaccard_join import one_of_each_class
from skein.llm.mixing import mix, take
from skein.llm.shared import bounded_batches, written
from skein.llm.toxicity import REJECT, fit, score

TOKENIZER = "byte_bpe_50k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity below REJECT, by a model fitted on the labelled ones among docs."""
    bounded_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("severity") < REJECT).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that are linked by 0.8 or more of their five-word shingles."""
    bounded_batches(spark)
    return one_of_each_class(docs, n=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take(mix(docs, share=1.5, weights=(5, 2, 1), cap=2))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and a digest of the text that they decode to."""
    bounded_batches(spark)
    path = public_tokenizers.path(TOKENIZER)
    rows = encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("mixing", mixed), ("byte-pair encoding", tokenized)]

#: Toxicity, ids and the hashes of token sets have no SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
