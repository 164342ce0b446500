"""Values that decide results: letters, marks, lists and default settings."""

from __future__ import annotations

import json
import string
from functools import lru_cache
from pathlib import Path

RESOURCES = Path(__file__).resolve().parent.parent / "resources"

# --- fixed values -----------------------------------------------------------
# Letter forms folded by normalisation (from, to).
LETTER_FOLDS = (("إ", "ا"), ("أ", "ا"), ("آ", "ا"), ("ى", "ي"), ("ؤ", "ء"), ("ة", "ه"), ("گ", "ك"))
# Fathatan, dammatan, kasratan, fatha, damma, kasra, shadda, sukun.
DIACRITICS = "ًٌٍَُِّْ"
TATWEEL = "ـ"

# Characters deleted by the punctuation rule ("/" becomes a space first).
ARABIC_PUNCTUATION = """`÷×=؛<>_()*&^%][ـ،:".,'{}~¦+|!”…“–ـ/$£•●"""
ASCII_PUNCTUATION = string.punctuation
DIGITS = "1234567890١٢٣٤٥٦٧٨٩٠"
BAD_CHARACTERS = "�¿áóóó□"

# Emoticons, symbols and pictographs, transport and map symbols, flags.
EMOJI_RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF))

# Edits of the base stop-word list: text cleaning.
CLEANING_STOPWORDS_KEPT = ("لا",)
CLEANING_STOPWORDS_ADDED = (
    "و", "ليه", "شركه", "اي", "تطبيقات", "جد", "تطبيق", "برامج", "ابلكيشن", "برنامج", "الي", "ال",
)
# Edits of the base stop-word list: topic terms.
TOPIC_STOPWORDS_KEPT = ("لا", "لكن")
TOPIC_STOPWORDS_ADDED = (
    "تطبيق", "التطبيق", "برنامج", "البرنامج", "ابلكيشن", "الابلكيشن", "جد", "جدا", "تطبيقات",
    "برامج", "الي", "ال", "اي", "ليه", "شركه", "او", "فوري",
)

# Affixes of the light stemmer, longest first (Larkey et al., light10).
PREFIXES = ("وال", "بال", "كال", "فال", "ال", "لل", "و")
SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")

# Cells that count as missing in a reviews CSV.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Class ids and names of the labelled reviews.
CLASS_NAMES = {0: "Negative", 1: "Positive", 2: "Suggestion", 3: "Issue", 4: "Question"}

# Names of the cleaning steps.
CLEANING_STEPS = (
    "normalize", "remove_url_email", "remove_punct", "remove_repeated_chars", "remove_repeated_words",
    "remove_long_words", "map_emojis", "remove_emojis", "remove_english", "remove_stopwords",
    "check_spelling", "stem", "segment",
)

# Default settings.
SEED = 2023
TOP_TERMS = 15
LONG_WORD = 10
TOPIC_STEPS_ON = (
    "normalize", "remove_stopwords", "remove_english", "remove_punct", "remove_repeated_chars",
    "remove_repeated_words", "remove_url_email", "map_emojis", "check_spelling",
)
CLASSIFIER_STEPS_ON = (
    "normalize", "remove_english", "remove_punct", "remove_repeated_chars", "remove_repeated_words",
    "remove_url_email",
)
TOPIC_DEFAULTS = {
    "task": "unsupervised", "n_topics": 5, "min_topic_size": 50,
    "candidate_topics": ("positive", "negative", "issue", "suggestion", "question"),
    "embd_technique": "sent", "max_length": 30, "dim_model_name": "pca", "n_components": 5,
    "clustering_model_name": "kmeans", "representation_model_list": ("keyBERT", "mmr", "zeroshot"),
    "ngram_range": (1, 3), "diversity": 0.3,
}
CLASSIFIER_DEFAULTS = {"max_len": 30, "n_nodes": 5, "n_layers": 2}
# --- end of fixed values ----------------------------------------------------


@lru_cache(maxsize=None)
def base_stopwords() -> tuple[str, ...]:
    """Our own short list of Arabic function words."""
    return tuple((RESOURCES / "stopwords_ar.txt").read_text(encoding="utf-8").split())


def cleaning_stopwords(base=None) -> tuple[str, ...]:
    return _edited(base, CLEANING_STOPWORDS_KEPT, CLEANING_STOPWORDS_ADDED)


def topic_stopwords(base=None) -> tuple[str, ...]:
    return _edited(base, TOPIC_STOPWORDS_KEPT, TOPIC_STOPWORDS_ADDED)


def _edited(base, kept, added) -> tuple[str, ...]:
    words = base_stopwords() if base is None else base
    return tuple(dict.fromkeys([w for w in words if w not in kept] + list(added)))


@lru_cache(maxsize=None)
def _emoji_items() -> tuple[tuple[str, str], ...]:
    return tuple(json.loads((RESOURCES / "emoji_words.json").read_text(encoding="utf-8")).items())


def emoji_words() -> dict[str, str]:
    """Our own short emoji-to-Arabic-word map."""
    return dict(_emoji_items())
