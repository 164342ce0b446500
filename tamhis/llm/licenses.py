"""License scan by template markup: optional and replaceable regions compiled into token automata.

Markup: plain words must stand exactly; ``<<beginOptional>> ... <<endOptional>>`` may be left out; ``<<var;words=a-b>>``
takes any ``a`` to ``b`` words. Regions nest. All templates run as one automaton over the words of a text; its sets of
states are built when first met and kept for the task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tamhis.llm.common import map_rows, words_of


class Template(NamedTuple):
    label: str
    markup: str
    #: Base templates are plain phrases; their places are counted.
    base: bool = False


#: Phrases and labels that a scan must find.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
TEMPLATES = (
    *BASE,
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
             " <<beginOptional>>and associated documentation files <<var;words=0-3>><<endOptional>> to deal in the software without restriction"),
    Template("apache-2", "licensed under <<beginOptional>>the terms of<<endOptional>> the apache license <<beginOptional>>version<<endOptional>> 2"),
    Template("gpl", "gnu <<beginOptional>>lesser<<endOptional>> general public license"
             " <<beginOptional>>as published by the free software foundation<<endOptional>>"
             " <<beginOptional>>either<<endOptional>> version <<var;words=1-1>>"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by <<var;words=0-3>> 4 0"),
    Template("all-rights-reserved", "copyright <<var;words=1-8>> all rights reserved"),
)
OUTPUT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
    ]))),
]
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
_ANY = None


class Automaton:
    """Token automaton of several templates. A state set is read by one word at a time."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self._steps: list[list[tuple[bytes | None, int]]] = []
        self._skips: list[list[int]] = []
        self._accepts: dict[int, int] = {}
        self.mandatory: list[int] = []
        starts = [self._compile(i, t.markup) for i, t in enumerate(self.templates)]
        self._memo: dict[tuple[int, bytes], int] = {}
        self._sets: list[frozenset[int]] = []
        self._ids: dict[frozenset[int], int] = {}
        self._accepted: list[tuple[int, ...]] = []
        self._words = {w for step in self._steps for w, _ in step if w is not _ANY}
        self.start = self._intern(frozenset(starts))
        self.first = {w for s in self._sets[self.start] for w, _ in self._steps[s]}
        if _ANY in self.first or self._accepted[self.start]:
            raise ValueError("a template must begin with a word")

    def _state(self) -> int:
        self._steps.append([])
        self._skips.append([])
        return len(self._steps) - 1

    def _compile(self, number: int, markup: str) -> int:
        begin = now = self._state()
        opened: list[int] = []
        mandatory = 0
        at = 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in words_of(markup[at : mark.start() if mark else len(markup)]):
                after = self._state()
                self._steps[now].append((word, after))
                mandatory += not opened
                now = after
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(now)
            elif mark[1] == "endOptional":
                after = self._state()
                self._skips[now].append(after)
                self._skips[opened.pop()].append(after)
                now = after
            else:
                low, high = int(mark[2]), int(mark[3])
                end = self._state()
                for taken in range(high + 1):
                    if taken >= low:
                        self._skips[now].append(end)
                    if taken < high:
                        after = self._state()
                        self._steps[now].append((_ANY, after))
                        now = after
                now = end
        if opened:
            raise ValueError("an optional region is not closed")
        self._accepts[now] = number
        self.mandatory.append(mandatory)
        return begin

    def _intern(self, states: frozenset[int]) -> int:
        todo, closed = list(states), set(states)
        while todo:
            for s in self._skips[todo.pop()]:
                if s not in closed:
                    closed.add(s)
                    todo.append(s)
        full = frozenset(closed)
        if full not in self._ids:
            self._ids[full] = len(self._sets)
            self._sets.append(full)
            self._accepted.append(tuple(sorted(self._accepts[s] for s in full if s in self._accepts)))
        return self._ids[full]

    def _next(self, state: int, word: bytes) -> int:
        key = (state, word if word in self._words else b"")
        if key not in self._memo:
            self._memo[key] = self._intern(frozenset(
                after for s in self._sets[state] for w, after in self._steps[s] if w is _ANY or w == word))
        return self._memo[key]

    def matches(self, words: Sequence[bytes]) -> list[tuple[int, int, int]]:
        """``(template, start, stop)`` of every place; of several stops from one start the last."""
        found: dict[tuple[int, int], int] = {}
        for start in [i for i, w in enumerate(words) if w in self.first]:
            state = self.start
            for i in range(start, len(words)):
                state = self._next(state, words[i])
                if not self._sets[state]:
                    break
                for number in self._accepted[state]:
                    found[number, start] = i + 1
        return [(number, start, stop) for (number, start), stop in found.items()]


def scan_licenses(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), text: str = "text",
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``keep`` columns and, for every row: word count, base places, labels, score and all matched spans.

    ``n_base`` counts all places of base templates, overlapping ones too; ``first_word`` and ``last_word`` are the
    smallest and largest start of these, null without one. ``labels`` has base and other labels, distinct, sorted and
    comma-joined. ``score`` is ``m / (m + 1)`` for the most mandatory words ``m`` of a template that accepts, else 0.
    A null or empty text has no words and no label. Rows are judged alone, so ties and repeated rows need no rule;
    other columns are not read. One pass, no shuffle.
    """
    templates = tuple(templates)

    def make():
        machine = Automaton(templates)
        joined = lambda labels: ",".join(sorted(set(labels)))

        def work(value):
            words = words_of(value)
            found = sorted(machine.matches(words), key=lambda m: (m[1], m[0]))
            base = [(templates[n].label, start) for n, start, _ in found if templates[n].base]
            starts = [start for _, start in base]
            best = max((machine.mandatory[n] for n, _, _ in found), default=0)
            spans = [{"label": templates[n].label, "start": start, "stop": stop} for n, start, stop in found]
            return (len(words), len(base), min(starts, default=None), max(starts, default=None), joined(x for x, _ in base),
                    joined(templates[n].label for n, _, _ in found), best / (best + 1), spans)

        return work

    return map_rows(docs, keep, [text], OUTPUT, make)
