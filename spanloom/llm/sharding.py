"""Contiguous shards of balanced size from global byte-size prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prefix_sums


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Cut the rows, in ascending order of doc_id, into `shards` contiguous runs of nearly equal bytes.

    A row's size is the UTF-8 length of its text plus 1. Per-partition totals give global prefix sums;
    a row belongs to the shard in whose equal slice of all bytes its middle byte lies, so each shard is
    within one row's size of its target. `slot` numbers a shard's rows from 0.

    Defined cases: a null text has size 1 and checksum 0; a null doc_id sorts first; rows with equal ids
    are ordered by checksum, then by a hash of the text; an empty table gives no rows; other columns are ignored. With
    fewer rows than shards, some shards are empty.
    """
    rows = only(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("__tie"),
    )
    placed, totals = prefix_sums(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("__tie")], {"__start": "size"}, "shards")
    total = max(totals["__start"], 1)
    # whole-number arithmetic: (2 * start + size) * shards stays below 2**63 up to 10**17 bytes
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * __start + size) * {shards}L) div {2 * total}L")).cast("int"))
    first = {r["shard"]: r["i"] for r in placed.groupBy("shard").agg(F.min("__index").alias("i")).collect()}  # at most `shards` rows
    base = reduce(lambda c, kv: c.when(F.col("shard") == kv[0], F.lit(kv[1])), first.items(), F.when(F.lit(False), F.lit(0).cast("long")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__index") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
