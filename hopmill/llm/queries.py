"""The thin queries of this subpackage: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmill.llm import chat, decontam, embeddings, langid, lexical, merkle, minhash, mixing, neighbours, repeats, sharding, tokens, urls
from hopmill.llm.common import read, stash, word_count

SHARDS, TOKEN_LIMIT = 16, 2048


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stash(read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokens.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.count_tokens(F.col("text"), vocabulary).alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(spark.createDataFrame(urls.LABELLED, "url string, label int"))
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(chat.gather(rows)).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(read(spark, sf_dir, "documents"), "source", ["doc_id"], ["doc_id", "source", "lang", "n_chars", "text"], without)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontam": op2_decontam,
    "op3_tokens": op3_tokens,
    "op4_embeddings": op4_embeddings,
    "op5_sharding": op5_sharding,
    "op6_urls": op6_urls,
    "op7_minhash": op7_minhash,
    "op8_repeats": op8_repeats,
    "op9_chat": op9_chat,
    "op10_langid": op10_langid,
    "op11_lexical": op11_lexical,
    "op12_neighbours": op12_neighbours,
    "op13_merkle": op13_merkle,
}
