"""Toxicity by compression distance: two zstandard dictionaries, and the lengths of windows compressed with each."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import map_rows, words_of
from tamhis.llm.language_id import remainder
from tamhis.session import small

#: Labelled documents of each class that the classifier is fitted on, in expectation, and the longest of them in characters.
FIT_DOCS, FIT_CHARS = 1_500, 65_536
#: Bytes of a window of running text, and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Bytes of the ordinary and of the toxic dictionary, bytes that a telling window must save, documents that a toxic passage must save them in.
ORDINARY_BYTES, TOXIC_BYTES, LEAST_GAIN, LEAST_DOCS = 1 << 20, 1 << 16, 2, 3
#: Share of ordinary documents, over that of toxic ones, from which a passage is ordinary.
ORDINARY_SHARE = 0.5
#: Passages that a half of the toxic documents shows to the other half, at first in bytes.
FIRST_BYTES = 1 << 18
ROUNDS = 4
_FRAME = 12
#: Windows from which they are compressed in one call, which makes a context of its own, and the most of such a call.
_MANY, _AT_ONCE = 256, 1 << 14
_STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 11])
OUTPUT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor with ``content`` as its dictionary, whose output has as little framing as there can be."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=21, hash_log=20, chain_log=20, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings)


def running(text: str | None) -> bytes:
    """The words of a text in their order, in lower case, each between blanks; empty without a word."""
    words = words_of(text)
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes) -> list[bytes]:
    """Windows of ``WINDOW`` bytes that overlap by half and together hold all of the running text."""
    return [text[i : i + WINDOW] for i in range(0, max(len(text) - WINDOW + STRIDE, 1), STRIDE)] if text else []


class Distance:
    """Bytes that a window saves with the toxic dictionary over the ordinary one.

    The toxic dictionary is the ordinary one with toxic passages after it, so wording that both know costs the same.
    Each window stands between two fixed bits of ordinary text, as the compressor looks for no match at the very end of its input.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self._head, self._tail = (ordinary[len(ordinary) * part // 6 :][:_FRAME] for part in (3, 2))
        self._ordinary, self._toxic = compressor(ordinary), compressor(ordinary + toxic)

    def gains(self, parts: Sequence[bytes]) -> list[int]:
        framed = [self._head + part + self._tail for part in parts]
        if len(framed) < _MANY:
            return [len(self._ordinary.compress(x)) - len(self._toxic.compress(x)) for x in framed]
        saved: list[int] = []
        for at in range(0, len(framed), _AT_ONCE):
            one, two = (c.multi_compress_to_buffer(framed[at : at + _AT_ONCE]) for c in (self._ordinary, self._toxic))
            saved += [len(a) - len(b) for a, b in zip(one, two, strict=True)]
        return saved

    def profile(self, text: bytes) -> np.ndarray:
        return self.profiles([text])[0]

    def profiles(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of features for each document; the windows of all are compressed in one go."""
        parts = [windows(text) for text in texts]
        saved = self.gains([part for own in parts for part in own])
        ends = list(accumulate(map(len, parts)))
        return np.array([self._features(saved[end - len(own) : end]) for own, end in zip(parts, ends, strict=True)])

    @staticmethod
    def _features(gains: Sequence[int]) -> np.ndarray:
        """Features of a document: how many of its windows, and which share of them, save so many bytes, and its length."""
        saved = np.array(gains or [0])
        above = (saved[:, None] >= _STEPS).sum(axis=0)
        return np.concatenate([np.log1p(above), np.sqrt(above / len(saved)), [saved.mean(), np.log(len(saved)), np.log1p((saved < 0).sum())]])

    def telling(self, window: bytes) -> list[bytes]:
        """The shortest runs of words of a window that save ``LEAST_GAIN`` bytes by themselves."""
        words = window.split()
        for n in range(1, len(words) + 1):
            runs = [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)]
            found = [run for run, saved in zip(runs, self.gains(runs), strict=True) if saved >= LEAST_GAIN]
            if found:
                return found
        return []

    def passages(self, parts: Sequence[bytes]) -> set[bytes]:
        return {p for part, saved in zip(parts, self.gains(parts), strict=True) if saved >= LEAST_GAIN for p in self.telling(part)}


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def content(passages: Counter, least: int, size: int) -> bytes:
    """Each passage once, the most frequent last, where a match costs least; the rarest go first if there are too many."""
    return b"".join(p for p, n in sorted(passages.items(), key=lambda x: (x[1], x[0])) if n >= least)[-size:]


def train_dictionaries(ordinary: Sequence[bytes], toxic: Sequence[bytes]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary content from the running text of labelled documents.

    Toxic documents are ordinary text for the most part, so their passages are sifted: a window of one half is telling if it is compressed better once
    the passages of the other half are in the dictionary, and its shortest part that still is becomes a passage. What comes back in
    ``LEAST_DOCS`` documents makes the toxic dictionary. Windows of ordinary documents that were left aside are put to the same
    test, and what is compressed better there in a comparable share of documents goes to the ordinary dictionary. Rounds repeat this with the passages found so far.
    """
    half = (len(ordinary) + 1) // 2
    base = b"".join(ordinary[:half])[-ORDINARY_BYTES:]
    aside = [windows(text) for text in ordinary[half:]]
    halves = [[windows(text) for text in toxic[k::2]] for k in (0, 1)]
    shown = [b"".join(w for doc in own for w in doc)[-FIRST_BYTES:] for own in halves]
    part = b""
    for _ in range(ROUNDS):
        found = []
        for own, other in ((0, 1), (1, 0)):
            distance = Distance(base, shown[other])
            found.append(Counter(p for doc in halves[own] for p in distance.passages(doc)))
        shown = [content(own, 2, TOXIC_BYTES) for own in found]
        every = found[0] + found[1]
        part = content(every, LEAST_DOCS, TOXIC_BYTES)
        distance = Distance(base, part)
        common = Counter(p for doc in aside for p in distance.passages(doc))
        base = b"".join(sorted(p for p, n in common.items() if n * len(toxic) >= ORDINARY_SHARE * every[p] * len(aside))) + base
    return base, part


def fit(docs: Sequence[tuple[bytes, int, float]]) -> Model | None:
    """Fits on ``(running text, label, weight)`` of documents; None unless both labels are there.

    Weights undo the sampling, so that a score of 0.5 stands for even odds in the whole table. The calibration of the window lengths is a
    logistic regression by Newton steps.
    """
    by_label = [[text for text, label, _ in docs if label == x] for x in (0, 1)]
    if not all(by_label):
        return None
    ordinary, toxic = train_dictionaries(*by_label)
    distance = Distance(ordinary, toxic)
    # What the ordinary dictionary holds as it stands says nothing about new documents.
    seen = set(by_label[0][: (len(by_label[0]) + 1) // 2])
    rated = [(text, label, weight) for text, label, weight in docs if label or text not in seen] if len(seen) < len(set(by_label[0])) else docs
    lost = sum(w for _, label, w in docs if not label) / sum(w for _, label, w in rated if not label)
    x = distance.profiles([text for text, _, _ in rated])
    y, weight = np.array([float(label) for _, label, _ in rated]), np.array([w if label else w * lost for _, label, w in rated])
    weight = weight / weight.sum() * len(rated)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 0.5 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(len(beta))
        beta -= np.linalg.solve(curve, slope)
    return Model(ordinary, toxic, centre, scale, beta)


def sample_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit_docs: int) -> list[tuple]:
    """Running text of a bounded sample of labelled documents, for ``fit``: of each class the ids of least hash.

    Labels are sampled before they meet the documents, so the documents are not moved.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    known = known.where(remainder("__id", 5) != 0)
    sizes = known.groupBy(F.col("__label").alias("__of")).agg(F.count(F.lit(1)).alias("__rows"))
    share = F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col("__rows"))
    sample = known.join(F.broadcast(sizes), F.col("__label") == F.col("__of")).select("__id", "__label", share.alias("__share"))  # two rows
    sample = sample.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 24)) < F.col("__share") * (1 << 24))
    texts = docs.where(F.length(text) <= FIT_CHARS).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(small(sample), "__id")

    def make():
        return lambda value: (running(value),)

    rows = map_rows(texts, ["__id", "__label", "__share"], ["__text"], [T.StructField("running", T.BinaryType())], make).collect()
    # Documents are dealt into halves by their text, not by their id.
    rows.sort(key=lambda r: (zlib.crc32(r["running"]), bytes(r["running"]), r["__label"]))
    return [(bytes(r["running"]), r["__label"], 1 / r["__share"]) for r in rows]


def score(docs: DataFrame, model: Model | None, keep: Sequence[str | Column], text: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` for every row of ``docs``, over the whole text."""
    def make():
        distance = Distance(model.ordinary, model.toxic) if model else None

        def work(values):
            if model is None:
                return [(0.0, 0)] * len(values)
            found = []
            for features in (distance.profiles([running(value) for value in values]) - model.centre) / model.scale:
                odds = float(features @ model.weights[:-1] + model.weights[-1])
                p = 1 / (1 + np.exp(-min(max(odds, -30.0), 30.0)))
                found.append((float(p), int(p >= 0.5)))
            return found

        return work

    return map_rows(docs, keep, [text], OUTPUT, make, together=True)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: Sequence[str | Column] = ("doc_id",), doc_id: str = "doc_id", text: str = "text",
                   label: str = "toxic", fit_docs: int = FIT_DOCS) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted`` for every row, by a classifier learned from ``labels``.

    Learned from rows with ``crc32(id) mod 5 <> 0`` alone, at most about ``fit_docs`` of each class (see ``FIT_DOCS``); labels
    other than 0 and 1 and null ids are passed over. Windows are bytes of the whole running text, so scripts
    without blanks have as many as others. A null or empty text has no window and gets the score of such; without documents of both classes all scores are 0. Equal
    texts have equal scores, repeated rows each get theirs, other columns are not read.
    """
    return score(docs, fit(sample_texts(docs, labels, doc_id, text, label, fit_docs)), keep, text)
