"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, huffman, mixing, neardup, packing, quality, repeats, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; only queries choose one, operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_archives(warc.search_index(pages, warc.archive(pages)), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(chat.nest_turns(rows.unionByName(more))))


def op3_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400-byte strings that repeat are removed; passages of over 50 words that repeat are counted beside."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), words=51)


def op4_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), odds=mixing.longer_first()).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lengths = huffman.write_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=0)
    return huffman.read_files(spark, files, lengths)


def op7_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, rules).drop("text")


def op10_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_capture_index, op2_chat_formatting, op3_induced_suffix_dedup, op4_setsketch_near_duplicates, op5_source_mixing, op6_huffman_tokens, op7_ivf_pq_neighbours, op8_bm25_packing, op9_quality_rules, op10_byte_balanced_shards)}
