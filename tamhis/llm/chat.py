"""Chat formatting: a state machine over roles, text segments with loss flags, and a reader of the output.

DataFrame functions only. Control strings inside texts are broken by a backslash after their first character; each
backslash of a text is doubled, so taking every backslash off its next character gives the text again.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Turn(NamedTuple):
    open: str
    close: str
    loss: bool


#: Declarative template: what stands around a turn of each role, and whether its text is learned.
TEMPLATE = {"system": Turn("<<SYS>>", "<</SYS>>", False), "user": Turn("[INST] ", " [/INST]", False), "assistant": Turn("<s>", "</s>", True)}
#: Any other role: its escaped name between the first two, then the text and the last.
NAMED = ("<|", "|>", "<|end|>")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>")
#: Which role may follow which; a chat ends in one of ``FINAL``.
TRANSITIONS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)

_BREAKS = "|".join(["(?=\\\\)", *[f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL]])
_OPEN = "|".join([*[re.escape(t.open) for t in TEMPLATE.values()], f"{re.escape(NAMED[0])}.*?{re.escape(NAMED[1])}"])
_CLOSE = "|".join(re.escape(x) for x in [*[t.close for t in TEMPLATE.values()], NAMED[2]])
_TURN = f"(?s)({_OPEN})(.*?)({_CLOSE})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BREAKS, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _segments(turn: Column) -> Column:
    def three(begin: Column, end: Column, loss: bool) -> Column:
        piece = lambda text, learned: F.struct(text.alias("text"), F.lit(learned).alias("loss"))
        return F.array(piece(begin, False), piece(turn["text"], loss), piece(end, False))

    chosen = three(F.concat(F.lit(NAMED[0]), turn["role"], F.lit(NAMED[1])), F.lit(NAMED[2]), False)
    for role, around in TEMPLATE.items():
        chosen = F.when(turn["role"] == role, three(F.lit(around.open), F.lit(around.close), around.loss)).otherwise(chosen)
    return chosen


def _checked(turns: Column) -> Column:
    """Struct of the last state and the first turn that may not follow, null if there is none."""
    allowed = F.array(*[F.lit(f"{state}>{role}") for state, roles in TRANSITIONS.items() for role in roles])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, start, lambda s, turn: F.struct(
        turn["role"].alias("state"), (s["place"] + 1).alias("place"),
        F.when(s["bad"].isNull() & ~F.array_contains(allowed, F.concat(s["state"], F.lit(">"), turn["role"])), s["place"]).otherwise(s["bad"]).alias("bad")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id, n_turns, valid, first_bad, segments, formatted``.

    Turns stand in the order of ``turn``; equal ones by escaped role and text, so ties and repeated rows have one order and
    each row is a turn. Null roles and texts are empty; a null ``conv_id`` is one conversation, a null ``turn`` comes first. Every conversation is
    formatted; ``valid`` tells whether the state machine takes all its turns and ends in a final state, ``first_bad``
    the place of the first turn it refuses. ``segments`` are ``(text, loss)`` in order, ``formatted`` their texts
    joined. An empty table gives no rows; other columns are not read. Texts are escaped before the one shuffle.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.explode(F.array(F.struct(_checked(F.col("turns")).alias("end"), F.flatten(F.transform("turns", _segments)).alias("segments")))).alias("made"))
    valid = F.col("made.end.bad").isNull() & F.col("made.end.state").isin(*FINAL)
    return made.select(
        "conv_id", "n_turns", valid.alias("valid"), F.col("made.end.bad").alias("first_bad"), F.col("made.segments").alias("segments"),
        F.array_join(F.col("made.segments.text"), "").alias("formatted"))


def read_turns(formatted: str | Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    part = lambda group: F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(group))

    def role_of(begin: Column) -> Column:
        role = unescape(F.substring(begin, F.lit(len(NAMED[0]) + 1), F.length(begin) - len(NAMED[0]) - len(NAMED[1])))
        for name, around in TEMPLATE.items():
            role = F.when(begin == around.open, F.lit(name)).otherwise(role)
        return role

    return F.zip_with(part(1), part(2), lambda begin, text: F.struct(role_of(begin).alias("role"), unescape(text).alias("text")))


def learned_text(segments: str | Column) -> Column:
    """All text under the loss mask, unescaped."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
