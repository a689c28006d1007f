"""Language of a text by its script, and language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_chars, is_blank

# Script ranges in the order they are tested.
SCRIPTS = (
    ("hi", r"\x{0900}-\x{097F}"),
    ("ru", r"\x{0400}-\x{04FF}"),
    ("zh", r"\x{4E00}-\x{9FFF}"),
    ("ja", r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}"),
    ("ko", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"),
    ("ar", r"\x{0600}-\x{06FF}"),
)

# Display names by language code.
LANGUAGE_NAMES = {
    "en": "English", "hi": "Hindi", "hi-en": "Hinglish", "fr": "French", "de": "German", "es": "Spanish",
    "pt": "Portuguese", "it": "Italian", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean",
    "ar": "Arabic", "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "mr": "Marathi", "gu": "Gujarati",
    "kn": "Kannada", "ml": "Malayalam", "pa": "Punjabi", "ur": "Urdu", "nl": "Dutch", "sv": "Swedish",
    "pl": "Polish", "tr": "Turkish", "th": "Thai", "vi": "Vietnamese",
}


def detect_language(text: Column) -> Column:
    """First script that covers more than half of the letters, else English."""
    letters = count_chars(text, r"\p{L}")
    expr = F.when(is_blank(text) | (letters == 0), "en")
    for code, script in SCRIPTS:
        expr = expr.when(count_chars(text, script) * 2 > letters, code)
    return expr.otherwise("en")


def normalize_language(code: Column) -> Column:
    """Hindi and Hinglish count as English, because the models read both."""
    return F.when(F.lower(code).isin("hi", "hi-en"), "en").otherwise(code)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    first = F.substring(code, 1, 1)
    return (
        F.when(code.isNull() | (code == ""), "Unknown")
        .when((F.length(code) > 3) & (first == F.upper(first)), code)
        .otherwise(F.coalesce(F.try_element_at(names, F.lower(code)), F.upper(code)))
    )


def apply_translations(df: DataFrame, memory: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Replace text by its stored English translation.

    ``memory(text_hash, lang, translated)`` holds one row per text and language. English text, unknown text and
    translations equal to the original are left as they are and marked ``was_translated = false``.
    """
    keyed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    wanted = memory.select("text_hash", F.col("lang").alias(language), "translated")
    usable = (
        F.col("translated").isNotNull()
        & (F.col("translated") != F.col(text))
        & ~F.lower(F.col(language)).isin("en", "english")
    )
    return (
        keyed.join(wanted, ["text_hash", language], "left")
        .withColumn("was_translated", F.coalesce(usable, F.lit(False)))
        .withColumn("text_to_analyze", F.when(F.col("was_translated"), F.col("translated")).otherwise(F.col(text)))
        .drop("text_hash", "translated")
    )
