"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import bound_batches, map_rows, stored
from tamhis.session import small

UNKNOWN = "und"
#: N-grams of a profile, and the distance of an n-gram that a profile lacks.
PROFILE = 300
#: Labelled rows per language that a profile is learned from, in expectation; all of them where there are fewer.
FIT_ROWS = 2000
OUTPUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
_BLANK = 32


class Grams:
    """Counts the letter n-grams, n from 1 to 3, of whole texts. An n-gram is one 63-bit number, 21 bits a letter."""

    def __init__(self):
        self._letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams in ascending order and how often each occurs. A run of other characters is one blank."""
        codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le"), np.uint32)
        letter = self._letter[codes]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] = True
        c = np.where(letter, codes, _BLANK)[kept].astype(np.int64)
        pairs = (c[:-1] << 21) | c[1:]
        grams = np.concatenate([c[c != _BLANK], pairs, (pairs[:-1] << 21) | c[2:]])
        grams.sort()
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent n-grams, most frequent first; equally frequent ones by their number."""
    return grams[np.lexsort((grams, -counts))[:most]]


def learn_profiles(docs: DataFrame, lang: str, text: str, order_by: Column, fit_rows: int = FIT_ROWS, size: int = PROFILE) -> dict[str, list[int]]:
    """Profile of every language with a letter in its texts: its ``size`` most frequent n-grams in order.

    Reads a bounded sample: of each language the rows whose 24-bit hash of ``order_by`` falls below the share that
    ``fit_rows`` is of its rows. Counts are summed in each task before they are dealt out; what reaches the driver is
    ``size`` numbers a language.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & order_by.isNotNull())
    sizes = known.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__rows"))
    place = F.pmod(F.xxhash64(order_by), F.lit(1 << 24))
    sample = known.join(small(sizes), F.col(lang) == F.col("__lang")).where(place * F.col("__rows") < fit_rows * (1 << 24))

    def count(batches):
        counter, sums = Grams(), {}
        for batch in batches:
            for name, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = sums.setdefault(name, {})
                for gram, n in zip(*[x.tolist() for x in counter.counts(value)], strict=True):
                    own[gram] = own.get(gram, 0) + n
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    bound_batches(docs.sparkSession)
    counted = sample.select("__lang", F.col(text).alias("__text")).mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in sorted(counted.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def out_of_place(doc: np.ndarray, keys: np.ndarray, ranks: np.ndarray, size: int) -> int:
    """Sum over the n-grams of a document, in rank order, of the distance to their rank in the profile."""
    at = np.minimum(np.searchsorted(keys, doc), len(keys) - 1)
    there = keys[at] == doc
    return int(np.where(there, np.abs(ranks[at] - np.arange(len(doc))), size).sum())


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep: Sequence[str | Column], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row of ``docs``, judged over the whole text.

    The language with the least out-of-place distance, of equal ones the first by name; the score is 1 less the share
    that the distance is of the largest possible. A text that is null or without a letter, and any text if there is no
    profile, is ``und`` with score 0. Rows are judged alone: repeated rows and extra columns make no difference.
    """
    def make():
        counter = Grams()
        tables = []
        for name in sorted(profiles):
            keys = np.array(profiles[name], np.int64)
            order = np.argsort(keys)
            tables.append((name, keys[order], order))

        def work(value):
            doc = ranked(*counter.counts(value), size)
            if not len(doc) or not tables:
                return UNKNOWN, 0.0
            distance, name = min((out_of_place(doc, keys, ranks, size), name) for name, keys, ranks in tables)
            return name, 1.0 - distance / (size * len(doc))

        return work

    return map_rows(docs, keep, [text], OUTPUT, make)


def remainder(doc_id: str, by: int) -> Column:
    """``crc32`` of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def predict_languages(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                      fit_rows: int = FIT_ROWS) -> DataFrame:
    """``keep``, ``lang_pred``, ``score``: profiles learned from rows with ``crc32(id) mod 3 <> 1``, applied to all rows.

    Rows with a null id, text or language are not learned from, but get a prediction like all others.
    """
    profiles = learn_profiles(docs.where(remainder(doc_id, 3) != 1), lang, text, F.col(doc_id), fit_rows)
    return identify(docs, profiles, keep, text)


def keep_identified(docs: DataFrame, least_score: float = 0.05, text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose language is known and whose score is at least ``least_score``.

    A verdict depends on the text alone, so only texts go to Python and only the digests of refused ones come back. Rows with a
    null text or one without a letter are refused; equal texts stay or go together.
    """
    judged = predict_languages(docs, [F.unhex(F.md5(F.col(text))).alias("__refused")], text=text, **options)
    refused = judged.where(F.col("__refused").isNotNull() & ((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score)))
    refused = stored(refused.select("__refused").distinct(), "refused")
    known = docs.where(docs[text].isNotNull())
    return known.join(small(refused), F.unhex(F.md5(known[text])) == refused["__refused"], "left_anti")
