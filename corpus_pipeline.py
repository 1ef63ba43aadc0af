"""Training-data pipeline over ``documents``: quality, near-duplicates, test leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of docs.
Empty tables, null ids and texts and repeated rows pass through every stage as its operator describes.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtempo.llm import bpe, decontaminate, quality, queries, secrets, simhash
from railtempo.session import checkpoint_root


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more); learnt from ``labels``."""
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out("doc_id")))
    return quality.with_quality(docs, model, into="_score").filter("_score >= 0.3").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (SimHash of three-word shingles, links at two or fewer differing bits)."""
    return simhash.one_of_each(docs, bits=2, words=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redacted(docs, secrets.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to the text's bytes."""
    coder = queries.public_bpe()
    coded = bpe.with_bytes(bpe.with_ids(docs, coder), coder)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), exact.alias("round_trip"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks), ("secrets", redact_secrets),
          ("bpe", encode)]
ORACLE_SQL = None  # compression, forests and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
