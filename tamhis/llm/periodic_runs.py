"""Periodic runs of words by maximal pairs: a bottom-up LCP-interval tree with left-word class lists."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import map_rows

WORD = "[^\\x20\\x09-\\x0D]+"
#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Two occurrences at distance q make a run of q + l words where l words repeat, so l >= 2 q and q + l >= 24: l is 16 at least.
_LEVELS = 4
LEAST_REPEAT = 1 << _LEVELS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
OUTPUT = [
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("longest", RUN), T.StructField("collapsed", T.StringType())]

Classes = dict[int, list[int]]


def repeats(codes: np.ndarray) -> bool:
    """False only if no ``LEAST_REPEAT`` words in a row occur twice."""
    if len(codes) <= LEAST_REPEAT:
        return False
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        for level in range(_LEVELS):
            step = 1 << level
            h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _MULTIPLIER + h[step:]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, common prefix of each suffix with the one before it, and a number for the ``LEAST_REPEAT`` words at each place.

    Ranks of the first 1, 2, 4, ... words are refined until all differ; the common prefixes are read off the ranks from the
    longest step to the shortest.
    """
    n = len(codes)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1]
    order = np.arange(n)
    while ranks[-1].max() < n or len(ranks) <= _LEVELS:
        step, rank = 1 << (len(ranks) - 1), ranks[-1]
        key = rank * (n + 1)
        key[: max(n - step, 0)] += rank[step:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        ranks[-1] = rank.astype(np.int32)
        ranks.append(new)
    order = np.argsort(ranks[-1])
    lcp = np.zeros(n, np.int64)
    before, after = order[:-1], order[1:]
    for level in range(len(ranks) - 1, -1, -1):
        a, b = before + lcp[1:], after + lcp[1:]
        inside = (a < n) & (b < n)
        same = ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)]
        lcp[1:] += np.where(inside & same, 1 << level, 0)
    return order, lcp, ranks[_LEVELS]


def near_repeats(order: np.ndarray, lcp: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, with their common prefixes, that can belong to a pair: some repeat is twice as long as their way to the next equal words."""
    n = len(order)
    places = np.argsort(grams, kind="stable")
    gaps = np.full(n + 1, n, np.int64)
    gaps[1:n] = np.where(grams[places[1:]] == grams[places[:-1]], np.diff(places), n)
    nearest = np.empty(n, np.int64)
    nearest[places] = np.minimum(gaps[:-1], gaps[1:])
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    kept = np.flatnonzero((longest >= LEAST_REPEAT) & (2 * nearest[order] <= longest))
    if not len(kept):
        return kept, kept
    return order[kept], np.minimum.reduceat(lcp[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))


def _pairs(few: Classes, many: Classes, repeat: int, found: dict[tuple[int, int], int]) -> None:
    """Maximal pairs between two children of an interval: other left words, and so near that they make a run."""
    reach = repeat // 2
    for word, places in few.items():
        for other, others in many.items():
            if other == word:
                continue
            for place in places:
                for i in range(bisect_left(others, place - reach), len(others)):
                    period = abs(others[i] - place)
                    if others[i] > place + reach:
                        break
                    if period + repeat >= LEAST_WORDS:
                        run = (min(place, others[i]), period + repeat)
                        found[run] = min(period, found.get(run, period))


def _merged(a: tuple[int, Classes], b: tuple[int, Classes], repeat: int, found: dict[tuple[int, int], int]) -> tuple[int, Classes]:
    """Two children as one, after their pairs are found; the smaller one's lists are added to those of the larger one."""
    (n_few, few), (n_many, many) = sorted((a, b), key=lambda x: x[0])
    _pairs(few, many, repeat, found)
    for word, places in few.items():
        own = many.get(word)
        if own is None:
            many[word] = places
        elif len(places) * 8 < len(own):
            for place in places:
                insort(own, place)
        else:
            own += places
            own.sort()
    return n_few + n_many, many


def maximal_pairs(codes: np.ndarray) -> dict[tuple[int, int], int]:
    """``(start, length)`` of every run and its smallest period.

    Intervals of the suffix array are closed from the longest common prefix to the shortest. An interval holds its places in one
    ordered list for each left word, the word before the place. A pair of places from different children cannot be
    extended to the right, one of different classes not to the left; if it is no further apart than half the common prefix, it is a run.
    Occurrences that near form one arithmetic progression, of which only the first can have another left word and only the last another
    right word: a place has at most one partner on each side, however long the run.
    """
    found: dict[tuple[int, int], int] = {}
    if not repeats(codes):
        return found
    places, common = near_repeats(*suffix_array(codes))
    left = np.concatenate([[-1], codes[:-1]])[places].tolist() if len(places) else []
    stack: list[tuple[int, tuple[int, Classes]]] = []
    closed: tuple[int, Classes] = (0, {})
    for place, word, repeat in zip([*places.tolist(), -1], [*left, -1], [*common.tolist(), 0], strict=True):
        if repeat < LEAST_REPEAT:
            repeat = 0
        while stack and stack[-1][0] > repeat:
            length, children = stack.pop()
            closed = _merged(children, closed, length, found)
        if repeat:
            if stack and stack[-1][0] == repeat:
                stack[-1] = repeat, _merged(stack[-1][1], closed, repeat, found)
            else:
                stack.append((repeat, closed))
        closed = (1, {word: [place]})
    return found


def runs_of(words: Sequence) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return sorted(((s, n, p) for (s, n), p in maximal_pairs(codes).items()), key=lambda r: (r[0], r[2]))


def longest_run(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, compared exactly; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (array of start, length, period), ``longest`` and ``collapsed`` for every row.

    Words are parted by ASCII white space and numbered from 0. A run is a stretch of at least 24 words and three periods, of smallest period ``period``,
    that no neighbouring word extends. ``longest`` is the run with the most periods, null if there is none. ``collapsed`` is the
    text without the words that some run holds after its first period, words joined by one blank.
    A null or empty text has no words, no runs and an empty collapsed text. Each row is worked off by itself, over its whole text;
    repeated rows have equal results and other columns are not read.
    """
    def make():
        def work(value):
            words = (value or "").encode().split()
            runs = runs_of(words)
            if runs:
                edges = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    edges[start + period] += 1
                    edges[start + length] -= 1
                words_left = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            else:
                words_left = words
            named = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            best = longest_run(runs)
            return len(words), named, best and dict(zip(("start", "length", "period"), best, strict=True)), b" ".join(words_left).decode()

        return work

    return map_rows(docs, keep, [text], OUTPUT, make)
