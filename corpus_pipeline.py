"""From raw documents to token ids in five stages; each stage's rows are written before the next reads them.

All stages take nulls in any column, empty and very long texts, repeated rows, an empty table and further
columns of any name. Null and empty texts have no words, no personal data and no tokens. All but the last
return the columns of their input in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.llm import bpe, decontam, pii, quality, simhash
from saleloom.llm.common import table
from saleloom.llm.queries import vocabulary
from saleloom.session import new_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; equal texts are kept or rejected alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash: that with the smallest doc_id.

    One of repeated rows stays, and one of all texts without words; a null doc_id counts as the largest.
    """
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; a document without words holds none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced in their texts."""
    return pii.sanitise(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    coded = bpe.encode_documents(docs, vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("bpe_encoding", as_tokens),
]

#: Boosted tables, XXH64 fingerprints and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; a document's last row holds doc_id, lang, source, n_tokens, ids and decoded."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
