"""A training-data pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked, sources are
mixed to their weights, and what is left is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which is what the stage before it kept, written and
read again. All but the last return the columns of documents. Ids may repeat or be null; null and blank texts are kept and harmless.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from featherloom.llm.bpe import Tokenizer
from featherloom.llm.common import written
from featherloom.llm.minhash import keep_one
from featherloom.llm.mixing import mix_sources
from featherloom.llm.pii import mask_pii
from featherloom.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs.select(*COLUMNS), labels, carry=True).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more, that of smallest id; rows without words stay.

    Rows are told apart by id and text, so that each group keeps exactly one row where ids repeat or are null.
    """
    return keep_one(docs.select(*COLUMNS), k=5, threshold=(80, 100), bands=32, rows=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans replaced by their kinds; n_chars follows the text."""
    return mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, 0 to 2 times."""
    return mix_sources(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    coder = Tokenizer(spark, public_tokenizers.path("word_bpe_49k.json")).fit(docs)
    return coder.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded").select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("personal-data", mask_personal_data), ("mixing", mix_to_weights), ("bpe", encode_texts)]
ORACLE_SQL = None      # classifiers, hash families and keyed coins are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
