"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept, written as Parquet and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import free_name, new_folder, read
from ledgerlight.llm.exact_dedup import drop_exact_duplicates
from ledgerlight.llm.ngram_join import one_of_each
from ledgerlight.llm.packing import pack
from ledgerlight.llm.secret_scan import redact
from ledgerlight.llm.tokenizers_path import byte_level_with_added
from ledgerlight.llm.toxicity import score_texts, trained_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine scores below 0.5. It learns from the labels that aren't held out.

    Null and empty texts have the lowest score and stay; rows that repeat an id are judged each; an empty table stays empty.
    """
    scorer = trained_on(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    score = free_name(docs, "_toxicity")
    return score_texts(docs, scorer, out_col=score).filter(F.col(score) < 0.5).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null counts as empty, a null id as smallest, and of rows of one id and text the last in file order stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more hold together: the first in file order.

    Null and empty texts and those of fewer than five words link to nothing and stay.
    """
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars to match. A null text stays null, with its own n_chars."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. A null text counts as empty, which has its end id only; rows of one id are documents of their own."""
    return pack(docs, byte_level_with_added(), with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
