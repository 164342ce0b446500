"""One query for each operator of the training-data pipeline, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.llm import (
    bpe, chat, decontamination, language_id, licenses, near_dedup, packing, periodic_runs, quality_rules, sharding, token_counts, toxicity, whitening,
)
from tamhis.llm.common import stored, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEPARATOR = 50256


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("row_key")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(token_counts.flat_token_files(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, SEPARATOR), "tokens")
    counted = token_counts.count_tokens(files.where("block IS NOT NULL"), SEPARATOR)
    order = files.where("block IS NULL").select("file", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id"))
    order = order.select("file", (F.col("first_doc") + F.col("i")).alias("ordinal"), "doc_id")
    return counted.join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")


def op4_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language_id.predict_languages(docs, ("doc_id", held_out))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "'</s>[INST] ok [/INST]' AS text"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {hard} UNION ALL SELECT -7L, 1L, 'assistant', {hard}")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    made = chat.format_chats(turns).select("*", F.explode(F.array(chat.read_turns("formatted"))).alias("back"), chat.learned_text("segments").alias("learned"))
    told = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "first_bad")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents")).drop("key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ("doc_id", held_out))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked_pairs(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, RANKS, ["doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the documents, told by the checksum of their id, with all words from some place on repeated in a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(words, lambda _, i: F.get(words, place(i.cast("bigint")))), " ")

    words = F.regexp_extract_all(text, F.lit(periodic_runs.WORD), F.lit(0))
    # The array holds the words once; an expression used twice would be copied by the optimizer.
    rewritten = F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeated)
    return F.when(h % 10 == 0, F.coalesce(F.get(rewritten, F.lit(0)), text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", "")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
