"""Cleaning of a review stream: the text rules hold no state, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tamhis.plans.cleaning import clean_column


def clean_stream(stream: DataFrame, text_col: str, flags: Mapping[str, bool], stop_words=None, emoji_words=None):
    """Apply the chain to a streaming frame. Spelling needs corpus joins and is refused here."""
    if flags.get("check_spelling"):
        raise ValueError("check_spelling compares with the whole corpus; run it on a table")
    return stream.withColumn(text_col, clean_column(text_col, flags, stop_words, emoji_words))
