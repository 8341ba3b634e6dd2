"""The corpus pipeline: five stages, each of which applies an operator of hopmill.llm to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmill.llm import decontam, langid, minhash, mixing, sharding
from hopmill.llm.common import read, shared_dir, stash, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts, texts without letters go, and all if nothing is labelled."""
    found = langid.predicted(docs)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Null, empty and wordless texts and rows with a null doc_id stay; of rows that share a doc_id one stays; texts are taken
    whole; an empty table gives an empty one. Only the columns of documents are read and returned.
    """
    return minhash.deduplicated(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; texts are taken whole; an empty table on
    either side takes nothing away. Only the columns of documents are returned.
    """
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn, three epochs at most.

    A null source is a source of its own, the last; null and empty texts have no words; repeated rows count each; an empty
    table gives an empty one.
    """
    return mixing.repeat(mixing.mix(docs.withColumn("_words", word_count(F.col("text"))), size="_words")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it: contiguous shards of nearly equal bytes.

    A null doc_id comes first and a null text has no bytes; repeated rows each have a slot; an empty table gives an empty one.
    """
    return sharding.shards(docs, SHARDS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shard", shard)]

#: SQL cannot express language identification; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, on the documents of sf_dir; what each returns is written to the shared folder and read again."""
    shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
