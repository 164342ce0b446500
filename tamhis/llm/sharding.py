"""Contiguous shards of equal bytes from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.llm.common import stored
from tamhis.session import running_totals, small


def shard_by_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; law ``bytes``.

    ``size`` is the UTF-8 length of the text (null: none) plus 1. Rows stand in one global order: MD5 of the text, then id, so
    that equal texts are neighbours. Each range of the order sums its own sizes, the totals of the ranges before it are
    added, and a row's shard is the place of its first byte in ``shards`` equal parts of all bytes. A group of equal
    texts that is no larger than the largest row goes where its first byte lies; a larger one is cut like any rows.
    So every shard is within one largest row of its equal part at either end, and only large groups of copies are
    cut. ``slot`` counts from 0 in a shard. Moved are hashes and numbers, never texts.

    Null texts count as empty, null ids come first, repeated rows get slots of their own. An empty table gives no rows.
    Other columns are not read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(value) + 1).cast("bigint").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        F.md5(value).alias("__hash"))
    placed = stored(running_totals(rows, [F.col("__hash"), F.col("doc_id")], {"__upto": F.col("size"), "__row": F.lit(1)}), "prefix")
    total, largest = placed.agg(F.sum("size"), F.max("size")).first()
    begin = F.col("__upto") - F.col("size")
    whole = placed.groupBy("__hash").agg(F.min(begin).alias("__begin"), F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n"))
    whole = stored(whole.where((F.col("__n") > 1) & (F.col("__bytes") <= (largest or 0))).select("__hash", "__begin"), "groups")
    shard = F.least(F.floor(F.coalesce("__begin", begin) * shards / F.lit(total or 1)), F.lit(shards - 1)).cast("int")
    cut = stored(placed.join(small(whole), "__hash", "left").select("doc_id", "size", "text_crc32", shard.alias("shard"), "__row"), "shards")
    firsts = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__row") - F.col("__first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
