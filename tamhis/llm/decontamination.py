"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import WordHasher, map_rows, stored, words_of
from tamhis.session import small

SHINGLE = 5
THRESHOLD = 0.8
#: Bits of the filters that go along with the tasks, whatever the number of items: 4 MB each.
FILTER_BITS = 25
_LONGS = T.ArrayType(T.LongType())
_TEXTS = T.ArrayType(T.StringType())


def shingle_hashes(hasher: WordHasher, text: str | None, k: int) -> np.ndarray:
    """63-bit hashes of the runs of ``k`` words of a text; none if it has fewer."""
    hashes = hasher.shingles(text, k)
    short = len(hashes) == 1 and len(words_of(text)) < k
    return np.zeros(0, np.int64) if short else (hashes >> np.uint64(1)).astype(np.int64)


def _runs(words: list[bytes], k: int) -> list[str]:
    return [b" ".join(words[i : i + k]).decode() for i in range(len(words) - k + 1)]


def itemised(items: DataFrame, item_id: str, item_text: str, k: int, threshold: float) -> DataFrame:
    """``item, key, k, shingles, sketch``: each distinct item, its distinct shingles, and the least hashes that stand for it.

    An item of fewer than ``k`` words is one shingle of all its words. If at least a share ``t`` of the ``q`` shingles of an item is in a document, at
    most ``q - ceil(t q)`` are not, so one of its ``q - ceil(t q) + 1`` least hashes is there. Items are parted by the power of two of ``q``; all
    sketches of a part have the width that its largest item needs. Whatever the length of the document, no item is missed.
    """
    source = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()

    def make():
        hasher = WordHasher()

        def work(text):
            words = words_of(text)
            size = min(k, len(words))
            if not size:
                return 0, [], []
            return size, sorted(set(_runs(words, size))), np.unique(shingle_hashes(hasher, text, size)).tolist()

        return work

    fields = [T.StructField("k", T.IntegerType()), T.StructField("shingles", _TEXTS), T.StructField("hashes", _LONGS)]
    made = map_rows(source, ["item", F.unhex(F.md5("text")).alias("digest")], ["text"], fields, make).where("k > 0")
    made = stored(made.withColumn("part", F.ceil(F.log2(F.size("shingles") + 1))).withColumn("key", F.monotonically_increasing_id()), "items")
    most = made.groupBy("part").agg(F.max(F.size("shingles")).alias("most"))  # a row for each power of two
    width = (F.col("most") - F.ceil(F.lit(threshold) * F.col("most") - 1e-9) + 1).cast("int")
    sketch = F.slice("hashes", F.lit(1), width)
    return made.join(F.broadcast(most), "part").select("item", "key", "k", "shingles", "hashes", sketch.alias("sketch"))


class Known(NamedTuple):
    """What a task needs to tell the documents that can hold an item: bit filters of fixed size, and the lengths of the shingles."""

    sketches: np.ndarray
    shingles: np.ndarray
    lengths: tuple[int, ...]


def _bits(hashes: DataFrame) -> np.ndarray:
    """Bit filter of the column ``h``, made in the tasks; the driver gets 64-bit words of it, at most ``2 ** (FILTER_BITS - 6)``."""
    bit = F.pmod("h", F.lit(1 << FILTER_BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {1 << FILTER_BITS}) & 63 AS int))")).alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()
    table[found["w"].to_numpy()] = found["b"].to_numpy()
    return table


def _inside(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & ((1 << FILTER_BITS) - 1)
    return (table[bit >> 6] >> (bit & 63)) & 1 == 1


def known_items(items: DataFrame) -> Known:
    lengths = tuple(sorted(r["k"] for r in items.select("k").distinct().collect()))  # at most SHINGLE rows
    return Known(_bits(items.select(F.explode("sketch").alias("h"))), _bits(items.select(F.explode("hashes").alias("h"))), lengths)


def meeting(docs: DataFrame, known: Known, keep: list[Column], text: str) -> DataFrame:
    """``keep`` columns, ``sketched`` and ``held`` of the rows that share a sketch hash with an item, filters aside.

    ``sketched`` are such hashes; ``held`` the distinct shingles of the whole text that can be an item's. All other documents end here.
    """
    def make():
        hasher = WordHasher()

        def work(value):
            sketched: set[int] = set()
            held: set[str] = set()
            words = None
            every = [(k, shingle_hashes(hasher, value, k)) for k in known.lengths] if value else []
            for _, hashes in every:
                sketched.update(hashes[_inside(known.sketches, hashes)].tolist())
            if sketched:
                words = words_of(value)
                for k, hashes in every:
                    held.update(b" ".join(words[i : i + k]).decode() for i in np.flatnonzero(_inside(known.shingles, hashes)).tolist())
            return sorted(sketched), sorted(held)

        return work

    return map_rows(docs, keep, [text], [T.StructField("sketched", _LONGS), T.StructField("held", _TEXTS)], make).where(F.size("sketched") > 0)


def find_items(docs: DataFrame, items: DataFrame, keep: list[Column], text: str = "text", item_id: str = "item_id", item_text: str = "text",
               k: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The rows that may hold an item, ``keep`` columns and ``digest`` of the text; and ``digest, item, shingles, found, containment`` of each item found.

    An item is found if at least ``threshold`` of its distinct runs of ``k`` words are in the whole text; an item of fewer words is one run of all of
    them. Words are compared in lower case without punctuation; an item without a word is never found, and null or empty texts hold none.
    Items with equal id and text count once; items that share an id are told apart by their text. Equal texts are compared once.

    One pass over the documents, with filters of fixed size, whatever the number of items. Documents that meet a sketch hash are
    joined with the items that have it, and the shingles of both are compared; no item and no document passes the driver.
    """
    found = stored(itemised(items, item_id, item_text, k, threshold), "itemised")
    rows = stored(meeting(docs, known_items(found), [*keep, F.unhex(F.md5(F.col(text))).alias("digest")], text), "meeting")
    texts = rows.groupBy("digest").agg(F.first("sketched").alias("sketched"), F.first("held").alias("held"))
    texts = stored(texts, "texts")
    sketches = stored(found.select("key", F.explode("sketch").alias("h")), "sketches")
    pairs = texts.select("digest", F.explode("sketched").alias("h")).join(small(sketches), "h").select("digest", "key").distinct()
    sides = pairs.join(texts.select("digest", "held"), "digest").join(small(found.select("key", "item", "shingles")), "key")
    counted = sides.select("digest", "item", F.size("shingles").cast("bigint").alias("shingles"), F.size(F.array_intersect("held", "shingles")).cast("bigint").alias("found"))
    leaks = counted.where(F.col("found") >= threshold * F.col("shingles") - 1e-9).withColumn("containment", F.col("found") / F.col("shingles"))
    return rows.drop("sketched", "held"), stored(leaks, "leaks")


def leaked_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, shingles, found, containment``: one row for each document and item found in it (see ``find_items``).

    Repeated rows each get theirs; columns other than the id and the text are not read. Without documents or items there are no rows.
    """
    rows, leaks = find_items(docs, items, [F.col(doc_id).alias("doc_id")], text, **options)
    return rows.join(small(leaks), "digest").select("doc_id", F.col("item").alias("item_id"), "shingles", "found", "containment")


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that hold no item (see ``find_items``).

    Only digests of leaking texts come back to the documents; null and empty texts stay, equal texts stay or go together.
    """
    _, leaks = find_items(docs, items, [], text, **options)
    bad = stored(leaks.select(F.col("digest").alias("__leaking")).distinct(), "leaking")
    return docs.join(small(bad), F.unhex(F.md5(docs[text])) == bad["__leaking"], "left_anti")
