"""Text rules as Spark columns; every rule takes and returns a string column.

The regular expressions avoid three traps. Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII by default, so
classes are spelt out or put under ``(?U)``. Starting points are anchored with look-behinds and repeats
are possessive, so that a long unbroken run of characters costs linear time. Nothing here splits a text
into rows: one rule is one expression in one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.functions import fixed

_SPACE = r"[\s\x1c-\x1f]"  # under (?U): every character that counts as white space in a Unicode string
_INK = r"[^\s\x1c-\x1f]"
_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[^\p{L}\p{N}_]"
_MARK = "\ue000"  # private-use separator, never part of a text


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_letters(c, folds: Iterable[tuple[str, str]] = fixed.LETTER_FOLDS) -> Column:
    """Replace letter forms by their base letter; pass other folds for other scripts."""
    folds = tuple(folds)
    return F.translate(_col(c), "".join(a for a, _ in folds), "".join(b for _, b in folds))


def strip_diacritics(c) -> Column:
    return F.translate(_col(c), fixed.DIACRITICS, "")


def strip_tatweel(c) -> Column:
    return F.translate(_col(c), fixed.TATWEEL, "")


def strip_space(c) -> Column:
    """Trim every Unicode white space, not only the blank."""
    return F.regexp_replace(_col(c), rf"(?U)\A{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", "")


def normalize(c, folds: Iterable[tuple[str, str]] = fixed.LETTER_FOLDS) -> Column:
    """Fold letters, delete diacritics and tatweel in one translate, then trim."""
    folds = tuple(folds)
    source = "".join(a for a, _ in folds) + fixed.DIACRITICS + fixed.TATWEEL
    return strip_space(F.translate(_col(c), source, "".join(b for _, b in folds)))


def remove_url_email(c) -> Column:
    """Delete links and e-mail addresses.

    An address takes the whole unbroken run it stands in, so it only needs to be tried where a run starts.
    """
    return F.regexp_replace(_col(c), rf"(?U)http{_INK}+|(?<!{_INK}){_INK}+@{_INK}+", "")


def punctuation_characters() -> str:
    """Characters deleted by :func:`remove_punctuation`, each once."""
    listed = fixed.ARABIC_PUNCTUATION + fixed.ASCII_PUNCTUATION + fixed.DIGITS + fixed.BAD_CHARACTERS
    return "".join(ch for ch in dict.fromkeys(listed) if ch != "/")


def remove_punctuation(c) -> Column:
    """Turn "/" into a blank and delete punctuation, digits and bad characters in one translate."""
    return F.translate(_col(c), "/" + punctuation_characters(), " ")


def collapse_repeated_chars(c) -> Column:
    """Any run of one character becomes that character; runs of line feeds stay."""
    return F.regexp_replace(_col(c), r"([^\n])\1++", "$1")


def collapse_repeated_words(c) -> Column:
    """Equal neighbouring words become one; the separators inside the run go too."""
    return F.regexp_replace(_col(c), rf"(?<!{_WORD})({_WORD}++)(?:{_GAP}++\1(?!{_WORD}))++", "$1")


def remove_long_words(c, limit: int = fixed.LONG_WORD) -> Column:
    """Keep the blank-separated tokens shorter than ``limit`` characters."""
    return F.array_join(F.filter(blank_tokens(c), lambda w: F.length(w) < limit), " ")


def map_emojis(c, words: Mapping[str, str] | None = None) -> Column:
    """Replace every mapped character by its word and one blank; unmapped ones stay.

    Only the distinct mapped characters found in a text are replaced, so a text without any costs one scan.
    """
    words = {k: v for k, v in (fixed.emoji_words() if words is None else words).items() if len(k) == 1}
    if not words:
        return _col(c)
    found = F.regexp_extract_all(_col(c), F.lit("[" + "".join(rf"\x{{{ord(k):X}}}" for k in words) + "]"), F.lit(0))
    table = F.create_map(*[F.lit(part) for pair in words.items() for part in pair])
    return F.aggregate(
        F.array_distinct(found),
        _col(c),
        lambda text, ch: F.replace(text, ch, F.concat(F.element_at(table, ch), F.lit(" "))),
    )


def remove_emojis(c) -> Column:
    """Delete emoticons, pictographs, transport signs and flags."""
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in fixed.EMOJI_RANGES)
    return F.regexp_replace(_col(c), f"[{ranges}]+", "")


def remove_latin(c) -> Column:
    """Delete the letters A-Z and a-z; accented letters and blanks stay."""
    return F.regexp_replace(_col(c), "[a-zA-Z]+", "")


def blank_tokens(c) -> Column:
    """Tokens between single blanks; neighbouring blanks give empty tokens."""
    return F.split(_col(c), " ", -1)


def remove_stopwords(c, words: Iterable[str] | None = None) -> Column:
    """Drop listed tokens. The list is a parameter held by the plan as a hash set."""
    words = fixed.cleaning_stopwords() if words is None else tuple(dict.fromkeys(words))
    if not words:
        return _col(c)
    return F.array_join(F.filter(blank_tokens(c), lambda w: ~w.isin(*words)), " ")


def detect_language(c) -> Column:
    """``en`` when the first ten characters hold a code in 65-122 and none in U+0600-U+06FF, else ``ar``."""
    head = F.substring(_col(c), 1, 10)
    return F.when(head.rlike(r"[\x41-\x7A]") & ~head.rlike(r"[\x{600}-\x{6FF}]"), "en").otherwise("ar")


def _affix_pattern() -> str:
    prefixes, suffixes = "|".join(fixed.PREFIXES), "|".join(fixed.SUFFIXES)
    return rf"(?<![^ ])(?:({prefixes})(?=[^ ]{{2}}))?([^ ]{{2,}}?)({suffixes})?(?![^ ])"


def stem(c) -> Column:
    """Light stemming: strip at most one prefix and one suffix, always leaving two characters."""
    return F.regexp_replace(_col(c), _affix_pattern(), "$2")


def segment(c) -> Column:
    """Split each token into prefix, stem and suffix joined by "+"."""
    cut = F.regexp_replace(_col(c), _affix_pattern(), f"$1{_MARK}$2{_MARK}$3")
    trimmed = F.regexp_replace(cut, rf"(?<![^ ]){_MARK}|{_MARK}(?![^ ])", "")
    return F.translate(trimmed, _MARK, "+")


def word_tokens(c, min_length: int = 2, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores of at least ``min_length`` characters."""
    source = F.lower(_col(c)) if lower else _col(c)
    return F.regexp_extract_all(source, F.lit(f"{_WORD}{{{min_length},}}"), F.lit(0))


def with_tokens(df: DataFrame, keep, tokens: Column, name: str = "w") -> DataFrame:
    """``keep`` columns and a token array that is computed once per row.

    Used twice, an expression would be copied into every use by the optimizer; the output of a generator is a
    column of its own, so here the array is exploded out of a one-element array.
    """
    return df.select(*keep, F.explode(F.array(tokens)).alias(name))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of a token array for n from ``low`` to ``high``, joined by blanks."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        last = F.size(tokens) - (n - 1)
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
        ).otherwise(F.array().cast("array<string>"))

    parts = [grams(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
