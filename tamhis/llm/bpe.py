"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where their boundaries agree, then encoded."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import map_rows

CHUNK = 32_768
OVERLAP = 1_024
#: Boundaries so near the end of a chunk could be moved by what follows, so they are not used.
_LOOKAHEAD = 4
OUTPUT = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]


def load_encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoded(df: DataFrame, keep: Sequence[str | Column], text: str, ranks_path: str, pattern: str) -> DataFrame:
    def make():
        encoding = load_encoding(ranks_path, pattern)

        def work(value):
            ids = np.array(encoding.encode_ordinary(value or ""), "<u4")
            return ids.tobytes(), len(ids)

        return work

    return map_rows(df, keep, [text], OUTPUT, make)


def _stitched(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(key, start, piece)`` whose pieces follow each other and together are the text of ``key``.

    Chunks begin every ``chunk`` characters and reach ``overlap`` further. A chunk other than the first may begin inside a
    pre-token, so its first boundaries can be wrong; as a match does not look back, all are right from the first
    one that it shares with the chunk before. There the pieces are cut. If a pair of chunks shares none, which takes
    a pre-token about as long as the overlap, all from the last cut to the end of the text is one piece.
    Boundaries after white space are not used: a cut there would hide from the pattern what follows.
    """
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    chunks = texts.select("key", F.length("text").alias("size"), "text", F.explode(starts).alias("start")).select(
        "key", "size", "start", F.col("text").substr(F.col("start") + 1, F.lit(chunk + overlap)).alias("piece"))
    # Copies of a text, and the chunks of one text, are dealt out over the tasks.
    chunks = chunks.groupBy("key", "start").agg(F.first("size").alias("size"), F.first("piece").alias("piece"))

    def make():
        matcher = regex.compile(pattern)

        def work(start, piece):
            bounds = [m.start() for m in matcher.finditer(piece)]
            sure = [b for b in bounds if b and b <= len(piece) - _LOOKAHEAD and not piece[b - 1].isspace()]
            return [start + b for b in sure if b < overlap], [start + b for b in sure if b >= chunk]

        return work

    places = T.ArrayType(T.LongType())
    marked = map_rows(chunks, ["key", "start", "size", "piece"], ["start", "piece"], [T.StructField("head", places), T.StructField("tail", places)], make)
    line = Window.partitionBy("key").orderBy("start")
    cut = F.when(F.col("start") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(line))))
    joined = marked.withColumn("cut", cut).withColumn("lost", F.max(F.col("cut").isNull()).over(line))
    joined = joined.withColumn("cut", F.when(~F.col("lost"), F.col("cut"))).withColumn("stop", F.lead("cut").over(line))
    last_cut = F.last("cut", ignorenulls=True).over(line)
    begin = F.coalesce("cut", F.col("start")) - F.col("start")
    # In a lost stretch chunks are put together again at their plain starts.
    end = F.coalesce("stop", F.least("size", F.col("start") + chunk)) - F.col("start")
    own = joined.select("key", last_cut.alias("at"), "start", F.col("piece").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    whole = own.groupBy("key", "at").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    return whole.select("key", F.col("at").alias("start"), F.array_join("parts.piece", "").alias("piece"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str | Column] = ("doc_id",), text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit numbers) and ``n_tokens`` for every row.

    Ids are those of encoding each match of ``pattern`` in the whole text separately by the ranks, without special
    tokens. Texts up to ``chunk`` characters are encoded where they are read. A longer text is encoded once, however many
    copies there are, from stitched chunks, and joined to its rows by MD5. A null or empty text has no tokens; rows
    with equal texts each get their ids. Other columns are not read.
    """
    if overlap <= _LOOKAHEAD or overlap > chunk:
        raise ValueError("the overlap must be longer than the look-ahead and at most a chunk")
    size = F.coalesce(F.length(text), F.lit(0))
    short = _encoded(docs.where(size <= chunk), keep, text, ranks_path, pattern)
    key = F.md5(F.col(text))
    long_rows = docs.where(size > chunk).select(*keep, key.alias("__key"))
    texts = docs.where(size > chunk).select(key.alias("key"), F.col(text).alias("text"))
    pieces = _encoded(_stitched(texts, pattern, chunk, overlap), ["key", "start"], "piece", ranks_path, pattern)
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("parts"), F.sum("n_tokens").alias("n_tokens"))
    whole = whole.select("key", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"), "n_tokens")
    long = long_rows.join(whole, long_rows["__key"] == whole["key"]).drop("__key", "key")
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks_path: str, keep: Sequence[str | Column], ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``: the bytes of all ids, joined. Null ids give no bytes; an id without a token is an error."""
    def make():
        with open(ranks_path, "rb") as lines:
            tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}

        def work(value):
            return (b"".join(map(tokens.__getitem__, np.frombuffer(value or b"", "<u4").tolist())),)

        return work

    return map_rows(encoded, keep, [ids], [T.StructField("decoded", T.BinaryType())], make)
