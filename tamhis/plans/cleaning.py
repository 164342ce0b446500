"""The cleaning chain and the whole preparation of a review table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions import text as tx
from tamhis.operators.quality import ID, check_quality
from tamhis.operators.spelling import build_word_counts, check_spelling
from tamhis.operators.translation import translate_english, untranslated
from tamhis.sources.sinks import write_reviews


def flags_from(steps: Iterable[str]) -> dict[str, bool]:
    steps = set(steps)
    return {s: s in steps for s in fixed.CLEANING_STEPS}


TOPIC_FLAGS = flags_from(fixed.TOPIC_STEPS_ON)
CLASSIFIER_FLAGS = flags_from(fixed.CLASSIFIER_STEPS_ON)

_BEFORE = fixed.CLEANING_STEPS[: fixed.CLEANING_STEPS.index("check_spelling")]
_AFTER = fixed.CLEANING_STEPS[fixed.CLEANING_STEPS.index("check_spelling") + 1 :]


def clean_column(c, flags: Mapping[str, bool], stop_words=None, emoji_words=None, steps=None) -> Column:
    """The rules that are on, in their fixed order, as one expression; spelling is not among them."""
    rules = {
        "normalize": tx.normalize,
        "remove_url_email": tx.remove_url_email,
        "remove_punct": tx.remove_punctuation,
        "remove_repeated_chars": tx.collapse_repeated_chars,
        "remove_repeated_words": tx.collapse_repeated_words,
        "remove_long_words": tx.remove_long_words,
        "map_emojis": lambda x: tx.map_emojis(x, emoji_words),
        "remove_emojis": tx.remove_emojis,
        "remove_english": tx.remove_latin,
        "remove_stopwords": lambda x: tx.remove_stopwords(x, stop_words),
        "stem": tx.stem,
        "segment": tx.segment,
    }
    known = {*fixed.CLEANING_STEPS, "translate_english"}
    unknown = sorted(set(flags) - known)
    if unknown:
        raise ValueError(f"unknown cleaning steps {unknown}")
    c = F.col(c) if isinstance(c, str) else c
    for step in steps or (*_BEFORE, *_AFTER):
        if flags.get(step):
            c = rules[step](c)
    return c


def clean_text(
    df: DataFrame, text_col: str, flags: Mapping[str, bool], stop_words=None, emoji_words=None,
    vocabulary: DataFrame | None = None, id_col: str = ID,
) -> DataFrame:
    """Apply the chain to a text column. Steps that are off are not in the plan; only spelling joins."""
    options = {"stop_words": stop_words, "emoji_words": emoji_words}
    if not flags.get("check_spelling"):
        return df.withColumn(text_col, clean_column(text_col, flags, **options))
    out = df.withColumn(text_col, clean_column(text_col, flags, steps=_BEFORE, **options))
    out = check_spelling(out, text_col, vocabulary, id_col=id_col)
    return out.withColumn(text_col, clean_column(text_col, flags, steps=_AFTER, **options))


def translated(df: DataFrame, text_col: str, flags: Mapping[str, bool], translations: DataFrame | None) -> DataFrame:
    """English texts by the memory if that step is on."""
    if not flags.get("translate_english"):
        return df
    if translations is None:
        raise ValueError("translate_english needs a translation memory (source_text, target_text)")
    return translate_english(df, text_col, translations)


def translation_work(df: DataFrame, text_col: str, translations: DataFrame, id_col: str = ID) -> DataFrame:
    """``(source_text)``: what ``preprocess`` would translate and the memory lacks."""
    return untranslated(check_quality(df, text_col, id_col), text_col, translations)


def learn_vocabulary(
    df: DataFrame, text_col: str, flags: Mapping[str, bool], stop_words=None, emoji_words=None, min_count: int = 5, id_col: str = ID,
    translations: DataFrame | None = None,
) -> DataFrame:
    """``(word, freq)`` of the texts as they are when spelling is checked. Learned once, it corrects any later text alike."""
    rows = translated(check_quality(df, text_col, id_col), text_col, flags, translations)
    early = rows.withColumn(text_col, clean_column(text_col, flags, stop_words, emoji_words, steps=_BEFORE))
    return build_word_counts(early, text_col, min_count)


def preprocess(
    df: DataFrame, text_col: str, flags: Mapping[str, bool], stop_words=None, emoji_words=None,
    vocabulary: DataFrame | None = None, translations: DataFrame | None = None, save_to: str | None = None,
    id_col: str = ID,
) -> DataFrame:
    """Quality check, translation, cleaning, quality check again; written to ``save_to`` when given."""
    out = translated(check_quality(df, text_col, id_col), text_col, flags, translations)
    out = clean_text(out, text_col, flags, stop_words, emoji_words, vocabulary, id_col)
    out = check_quality(out, text_col, id_col)
    if save_to is None:
        return out
    write_reviews(out, save_to)
    return out.sparkSession.read.schema(out.schema).parquet(save_to)
