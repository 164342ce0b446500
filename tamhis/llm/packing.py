"""Packing: texts as one stream of tokens, cut into windows by two-pass prefix sums, with a record at each boundary."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import map_rows, stored
from tamhis.session import small

LENGTH = 1024
END = 0
#: Characters that are encoded at once; longer texts are cut before a blank or line end that follows a letter or digit.
PART = 1 << 18
_CUT = re.compile(r"(?<=[^\W_])[ \n]")
_BYTES = 4
OUTPUT = [T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def load_tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file; its ids are the ranks of its merges, which is checked."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    vocabulary = {token: i for token, i in made["model"]["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
    ids = [vocabulary["".join(m)] for m in merges]
    if ids != sorted(ids) or len(vocabulary) != len(merges) + 256 or made["normalizer"] or made["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a byte-level BPE whose ids follow its merges")
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def parts_of(text: str, size: int = PART) -> list[str]:
    """``text`` in parts of about ``size`` characters that are encoded apart with the same result.

    White space is a pre-token of its own or its first character, so there is always a boundary between a letter and a blank.
    """
    parts, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def tokenize(docs: DataFrame, path: str, keep: Sequence[str | Column], text: str = "text", end: int = END) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit, with ``end`` last), ``doc_tokens``, ``part`` and ``before``: the task and its tokens up to the row."""
    def make():
        tokenizer, part, total = load_tokenizer(path), TaskContext.get().partitionId(), 0

        def work(value):
            nonlocal total
            ids = [np.array(tokenizer.encode(p, allowed_special="all"), "<u4").tobytes() for p in parts_of(value or "")]
            ids = b"".join([*ids, np.uint32(end).astype("<u4").tobytes()])
            before, total = total, total + len(ids) // _BYTES
            return ids, len(ids) // _BYTES, part, before

        return work

    return map_rows(docs, keep, [text], OUTPUT, make)


def pack(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of a document: ``keep`` columns, ``start, length, ids, doc_tokens, sequence_id, offset``.

    All documents, each closed by the token ``end``, are one stream; a sequence is a window of ``length`` tokens of it, and a
    document is cut only where a window ends, so each sequence but the last is full. ``start`` is the piece's place in its document, ``offset`` its place in
    its sequence. The first pass writes the tokens of each task with their running total; the second adds the totals of the tasks
    before, one number for each task, and cuts every document by itself. Documents and tokens are never shuffled.

    A null or empty text is one token, ``end``. Repeated rows are packed one by one; a text longer than a sequence has a piece
    in each of its windows. An empty table has no pieces. Columns other than ``keep`` and ``text`` are not read. The order of documents is that of the
    tasks that read them; it is fixed once the tokens are written.
    """
    made = stored(tokenize(docs, path, [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")], text, end), "packed")
    totals = stored(made.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total")), "totals")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("ahead"))
    placed = made.join(small(offsets), F.col("part") == F.col("of")).withColumn("at", F.col("ahead") + F.col("before"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("doc_tokens") - 1) / length)

    def piece(window: Column) -> Column:
        begin = F.greatest(window * length - F.col("at"), F.lit(0).cast("bigint"))
        size = F.least((window + 1) * length - F.col("at"), F.col("doc_tokens")) - begin
        ids = F.substring(F.col("ids"), (begin * _BYTES + 1).cast("int"), (size * _BYTES).cast("int"))
        return F.struct(begin.alias("start"), size.alias("length"), ids.alias("ids"), window.alias("sequence_id"),
                        F.greatest(F.col("at") - window * length, F.lit(0).cast("bigint")).alias("offset"))

    cut = placed.select("kept", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("piece"))
    return cut.select("kept.*", "piece.start", "piece.length", "piece.ids", "doc_tokens", "piece.sequence_id", "piece.offset")


def sequences(pieces: DataFrame, keep: Sequence[str] = ("doc_id",), length: int = LENGTH, pad: int = END) -> DataFrame:
    """``sequence_id, ids, n_tokens, boundaries``: each sequence of ``pack``, padded to ``length``, with a record for each piece in it.

    ``boundaries`` is an array of ``offset, length, start`` and the ``keep`` columns, by offset; ``n_tokens`` leaves the padding out.
    A sequence has at most ``length`` pieces.
    """
    record = F.struct("offset", "length", "start", *keep, "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(record)).alias("parts"), F.sum("length").alias("n_tokens"))
    filler = F.format_string("%08x", F.lit(int.from_bytes(int(pad).to_bytes(_BYTES, "little"), "big")))
    ids = F.concat(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""), F.repeat(filler, (F.lit(length) - F.col("n_tokens")).cast("int")))
    return whole.select("sequence_id", F.unhex(ids).alias("ids"), "n_tokens", F.transform("parts", lambda p: p.dropFields("ids")).alias("boundaries"))
