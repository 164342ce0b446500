"""Spelling correction against a corpus vocabulary by equi-joins alone.

A word within two edits of a short token meets it in a shared *form*: letters deleted on either side, or replaced
by a blank on both. ``blanks + letters deleted from the token + letters deleted from the word`` is the number
of edits. The vocabulary index keeps one word, the best, per ``(form, letters deleted)``, so the join key is
unique on that side: a token meets at most one row per form, however many words share the form, and no
list of candidate pairs is built.

Short forms are shared by many words, long ones by few. Tokens of more than ``UNIQUE_LENGTH`` letters therefore meet words in what is left
of both after deletions alone, a quarter of the forms and known by their hash, and the distance is then counted.

The number of forms grows with the square of the length, so the longest tokens go a third way to the same result: of three
parts of a word two edits leave one whole, at most two places from where it was. Token and word meet in such a part, and
the distance is then counted.

All forms of a corpus are many times its size. Two forms are equal only if they are equally long, so they meet in rounds of form lengths
(and of hashes, where one length has most forms), and only one round's forms are on disk.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.functions import text as tx
from tamhis.operators.quality import ID
from tamhis.session import pin, small

_BLANK = "\ue001"  # private-use character standing for a replaced letter
UNIQUE_LENGTH = 6  # tokens up to here are met by forms with a unique key, longer ones by deletions
FORM_LENGTH = 25  # tokens up to here are met by forms or deletions, longer ones by parts
ROUND_FORMS = 4 << 20  # forms that are not worth a round of their own
ROUNDS = 10  # about so many rounds share the forms of a large corpus
COMMON_WORDS = 1 << 16  # most frequent words, taken off the tokens of texts before these are shuffled
FIXES_BYTES = 8 << 20  # a broadcast passes through the driver, and takes several times its measured size there


def build_word_counts(df: DataFrame, text_col: str, min_count: int = 5) -> DataFrame:
    """Vocabulary ``(word, freq)`` of blank-separated tokens seen at least ``min_count`` times."""
    words = df.select(F.explode(tx.blank_tokens(text_col)).alias("word")).where(F.col("word") != "")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_count)


def _cut(word: Column, i: Column, put: str) -> Column:
    """``word`` with character ``i`` replaced by ``put``."""
    return F.concat(F.substr(word, F.lit(1), i - 1), F.lit(put), F.substr(word, i + 1))


def _forms(df: DataFrame, word: str, edits: int) -> DataFrame:
    """``df`` with one row per form of ``word``: ``(form, blanks, deleted)``, ``blanks + deleted <= edits``.

    Places i <= j are exploded (0 is "nowhere"), so that the strings are cut in generated code; a form may repeat.
    """
    size = F.length(word)
    first = F.sequence(F.lit(0), size) if edits == 2 else F.array(F.lit(0))
    spots = df.select("*", F.explode(first).alias("i")).select("*", F.explode(F.sequence("i", size)).alias("j"))
    i, j = F.col("i"), F.col("j")

    def form(put_i: str | None, put_j: str | None):
        value, puts = F.col(word), [p for p in (put_i, put_j) if p is not None]
        if put_j is not None:
            value = _cut(value, j, put_j)
        if put_i is not None:
            value = _cut(value, i, put_i)
        return F.struct(
            value.alias("form"), F.lit(puts.count(_BLANK)).alias("blanks"), F.lit(puts.count("")).alias("deleted")
        )

    both = [form(a, b) for a in (_BLANK, "") for b in (_BLANK, "")]
    made = (
        F.when(j == 0, F.array(form(None, None)))
        .when(i == 0, F.array(form(None, _BLANK), form(None, "")))
        .when(i < j, F.array(*both))
    )
    return spots.select(*df.columns, F.inline(made))


def _rounds(tokens: DataFrame, vocabulary: DataFrame, edits: int, lengths: tuple[int, int], blanks: bool) -> list[tuple[int, int, int, int]]:
    """``(shortest, longest, part, parts)``: the rounds in which forms of all ``lengths`` meet; a crowded length meets in parts."""
    first, last = max(0, lengths[0] - edits), lengths[1]
    sizes = tokens.select(F.length("token").alias("n")).where(F.col("n").between(*lengths)).unionAll(
        vocabulary.select(F.length("word").alias("n")).where(F.col("n").between(1, last + edits))
    )
    seen = {r["n"]: r["count"] for r in sizes.groupBy("n").count().collect()}

    def forms(n: int, deleted: int) -> int:
        kept = math.comb(n, deleted)
        return kept * sum(math.comb(n - deleted, b) for b in range(edits - deleted + 1)) if blanks else kept

    volume = {f: sum(seen.get(f + d, 0) * forms(f + d, d) for d in range(edits + 1)) for f in range(first, last + 1)}
    share = max(ROUND_FORMS, math.ceil(sum(volume.values()) / ROUNDS))
    rounds, begin, held = [], first, 0
    for f, forms_here in volume.items():
        if held and held + forms_here > share:
            rounds.append((begin, f - 1, 0, 1))
            begin, held = f, 0
        held += forms_here
        if held > share:  # a length alone
            parts = math.ceil(held / share)
            rounds += [(f, f, part, parts) for part in range(parts)]
            begin, held = f + 1, 0
    return [*rounds, (begin, last, 0, 1)] if begin <= last else rounds


def _in_part(form: Column, part: int, parts: int) -> Column:
    return F.pmod(form, F.lit(parts)) == part if parts > 1 else F.lit(True)


def _round_forms(df: DataFrame, word: str, edits: int, turn: tuple[int, int, int, int]) -> DataFrame:
    shortest, longest, part, parts = turn
    rows = _forms(df.where(F.length(word).between(max(1, shortest), longest + edits)), word, edits)
    return rows.where(F.length("form").between(shortest, longest) & _in_part(F.xxhash64("form"), part, parts))


def _index(vocabulary: DataFrame, edits: int, turn: tuple[int, int, int, int]) -> DataFrame:
    """Best word per ``(form, letters deleted from the word)``: most frequent, then the larger string.

    No form of a token is longer than the token, so longer forms are left out.
    """
    rows = _round_forms(vocabulary.select("word", "freq"), "word", edits, turn)
    return rows.groupBy("form", "deleted").agg(F.max(F.struct("freq", "word")).alias("best"))


def _within(tokens: DataFrame, vocabulary: DataFrame, edits: int, turn: tuple[int, int, int, int]) -> DataFrame:
    """``(token, best)``: best word at ``edits`` edits per token by the forms of one round, given that nothing is nearer."""
    probes = _round_forms(tokens.select("token"), "token", edits, turn).select(
        "token", "form", (F.lit(edits) - F.col("blanks") - F.col("deleted")).alias("deleted")
    )
    met = probes.join(_index(vocabulary, edits, turn), ["form", "deleted"])
    return met.groupBy("token").agg(F.max("best").alias("best"))


def _deletions(df: DataFrame, word: str, edits: int, turn: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``df`` with the hash ``key`` of each form that up to ``edits`` deletions leave of ``word``, of one round only if named; a key may repeat."""
    size, lowest, high = F.length(word), F.lit(0), F.length(word)
    if turn is not None:
        df = df.where(size.between(turn[0], turn[1] + edits))
        # Where two letters must go, none is nowhere; where at most one or none may go, one place or both are.
        lowest = F.when(size - turn[1] >= 2, 1).otherwise(0)
        high = F.when(size - turn[0] >= 2, size).otherwise(0)
    first = F.sequence(lowest, F.greatest(lowest, high)) if edits == 2 else F.array(F.lit(0))
    last = size if turn is None else F.when(size - turn[0] >= 1, size).otherwise(0)
    spots = df.select("*", F.explode(first).alias("i")).select("*", F.explode(F.sequence("i", F.greatest(F.col("i"), last))).alias("j"))
    i, j = F.col("i"), F.col("j")
    spots = spots.where((j == 0) | (i < j))
    if turn is not None:
        spots = spots.where((size - (i > 0).cast("int") - (j > 0).cast("int")).between(turn[0], turn[1]))
    one = F.when(j == 0, F.col(word)).otherwise(_cut(F.col(word), j, ""))
    left = spots.select(*df.columns, "i", one.alias("left"))
    keyed = left.select(*df.columns, F.xxhash64(F.when(F.col("i") == 0, F.col("left")).otherwise(_cut(F.col("left"), F.col("i"), ""))).alias("key"))
    return keyed if turn is None else keyed.where(_in_part(F.col("key"), *turn[2:]))


def _by_deletions(tokens: DataFrame, vocabulary: DataFrame, edits: int, turn: tuple[int, int, int, int]) -> DataFrame:
    """``(token, best)``: best word at ``edits`` edits per token by what deletions leave in one round, given that nothing is nearer."""
    index = _deletions(vocabulary.select("word", "freq"), "word", edits, turn)
    met = _deletions(tokens.select("token"), "token", edits, turn).join(index, "key")
    near = met.where(F.levenshtein("token", "word", edits) == edits)
    return near.groupBy("token").agg(F.max(F.struct("freq", "word")).alias("best"))


def _nearest(tokens: DataFrame, vocabulary: DataFrame, edits: int, unique: int, length: int) -> DataFrame:
    """``(token, fix)``: best word at ``edits`` edits per token of up to ``length`` letters, given that nothing is nearer."""
    found = []
    for way, low, high in ((_within, 1, unique), (_by_deletions, unique + 1, length)):
        rows = tokens.where(F.length("token").between(low, high))
        turns = _rounds(tokens, vocabulary, edits, (low, high), way is _within) if low <= high else []
        met = [way(rows, vocabulary, edits, turn) for turn in turns]
        if len(turns) > 1:
            # What one round shuffles is deleted before the next. A token has a best word in each.
            met = [pin(m) for m in met]
            met = [reduce(DataFrame.unionAll, met).groupBy("token").agg(F.max("best").alias("best"))]
        found += met
    return reduce(DataFrame.unionAll, found).select("token", F.col("best.word").alias("fix"))


def _by_parts(tokens: DataFrame, vocabulary: DataFrame, length: int) -> DataFrame:
    """``(token, fix)`` for tokens longer than ``length``: the nearest word within two edits."""
    words = vocabulary.where(F.length("word") > length - 2).withColumn("size", F.length("word"))
    at = lambda part: F.floor(part * F.col("size") / 3).cast("int")
    part = F.col("part")
    begin, wide = at(part), at(part + 1) - at(part)
    parts = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("part")
    index = words.select("word", "freq", "size", parts).select("size", "part", F.substr("word", begin + 1, wide).alias("piece"), "word", "freq")
    probes = tokens.where(F.length("token") > length).select("token", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2)).alias("size"))
    probes = probes.select("token", "size", parts).select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift"))
    start = begin + F.col("shift")
    inside = (start >= 0) & (start + wide <= F.length("token"))
    probes = probes.where(inside).select("token", "size", "part", F.substr("token", start + 1, wide).alias("piece"))
    met = probes.join(index, ["size", "part", "piece"]).select("token", "word", "freq").distinct()
    near = met.withColumn("edits", F.levenshtein("token", "word", 2)).where("edits >= 0")
    best = near.groupBy("token").agg(F.max(F.struct((-F.col("edits")).alias("near"), "freq", "word")).alias("best"))
    return best.select("token", F.col("best.word").alias("fix"))


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame, length: int = FORM_LENGTH) -> DataFrame:
    """``(token, fix)`` for the distinct tokens that have a better spelling.

    Known tokens and empty ones count as right. A word one edit away goes before a word two edits away; among equals
    the most frequent wins, then the larger string. ``length`` parts the two ways to look and changes no result.
    """
    vocabulary = pin(vocabulary.select("word", "freq"))
    unknown = (
        tokens.where(F.length("token") >= 1)
        .select("token")
        .distinct()
        .join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    )
    # These tables are used several times and would otherwise read the corpus again each time.
    unknown = pin(unknown)
    unique = min(UNIQUE_LENGTH, length)

    near = pin(_nearest(unknown, vocabulary, 1, unique, length))
    rest = pin(unknown.join(near, "token", "left_anti"))
    return near.unionByName(_nearest(rest, vocabulary, 2, unique, length)).unionByName(_by_parts(unknown, vocabulary, length))


def check_spelling(
    df: DataFrame, text_col: str, vocabulary: DataFrame | None = None, min_count: int = 5, id_col: str = ID, stored: bool = False,
) -> DataFrame:
    """Correct the blank-separated tokens of each text; a text of one token stays as it is.

    The corpus is turned into tokens once per document and token. Only tokens that do have a fix come
    back, grouped by document into a small map that is applied inside the row. The most frequent words, which are known and make up most
    of any text, are left out before tokens are shuffled. ``stored``: ``df`` only reads a table, which need not be kept a second time.
    """
    several = F.size(tx.blank_tokens(text_col)) > 1
    df = df if stored else pin(df)  # read four times below
    vocabulary = pin(build_word_counts(df, text_col, min_count) if vocabulary is None else vocabulary.select("word", "freq"))
    common = F.broadcast(pin(vocabulary.orderBy(F.desc("freq"), "word").limit(COMMON_WORDS).select(F.col("word").alias("token"))))
    used = df.where(several).select(id_col, F.explode(F.array_distinct(tx.blank_tokens(text_col))).alias("token"))
    fixes = small(pin(correct_tokens(used, vocabulary)), FIXES_BYTES)
    per_doc = (
        used.join(common, "token", "left_anti")
        .join(fixes, "token")
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "fix"))).alias("__fixes"))
    )
    fixed = F.array_join(
        F.transform(tx.blank_tokens(text_col), lambda w: F.coalesce(F.element_at("__fixes", w), w)), " "
    )
    joined = df.join(per_doc, id_col, "left")
    return joined.withColumn(text_col, F.when(F.col("__fixes").isNull(), F.col(text_col)).otherwise(fixed)).select(
        *df.columns
    )
