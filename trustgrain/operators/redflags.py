"""Rule-based warning signs inside one review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.pages import any_part
from ..functions.text import SPACE, WORD, count_chars, strip, words
from .detections import ratio

_B, _E = rf"(?<!{WORD})", rf"(?!{WORD})"

# Wording that the rules look for, on lower-case text.
GENERIC = rf"{_B}(good|bad|great|awesome|terrible|worst|best|amazing){SPACE}+(product|item|quality|service){_E}"
SUSPICIOUS = (
    (rf"{_B}(only|just){SPACE}+\d+{SPACE}+(left|remaining){_E}", "Fake urgency - 'Only X left!'", ("left", "remaining")),
    (rf"{_B}(order|sell|buy){SPACE}+(fast|quick|now){_E}", "Fake urgency", ("order", "sell", "buy")),
    (rf"{_B}(first{SPACE}+time{SPACE}+(buyer|user|customer)){_E}", "Fake first-timer claims", ("first",)),
    (
        rf"{_B}(5{SPACE}*star|five{SPACE}*star|one{SPACE}*star|1{SPACE}*star){SPACE}+(rating|review){_E}",
        "Explicit star claims",
        ("star",),
    ),
)
DETAILS = (
    rf"\d+{SPACE}*(gb|mb|kg|cm|mm|inch|hour|minute|day|week|month|year)",
    r"\$\d+",
    rf"{_B}\d{{4}}{_E}",
    rf"{_B}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec){_E}",
)
WEIGHTS = {"high": 30, "medium": 15, "low": 5}


def _flag(kind: str, severity: str, description: Column | str, evidence: Column | str) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        lit(description).alias("description"),
        lit(evidence).alias("evidence"),
    )


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def flags(text: Column, low: Column, low_words: Column) -> Column:
    """All flags of a text in rule order; its lower-case form and the words of that are columns of their own, so that
    they are computed once."""
    letters = count_chars(text, r"\p{L}")
    upper = ratio(count_chars(text, r"\p{Lu}"), letters)
    bangs = _occurrences(text, "!")
    questions = _occurrences(text, "?")
    n_words = F.size(low_words)
    pairs = F.filter(
        F.zip_with(
            low_words,
            F.slice(low_words, 2, F.greatest(F.size(low_words), F.lit(1))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
        lambda p: p.isNotNull(),
    )
    # The plain words that a pattern cannot do without are looked for first; few texts need the pattern itself.
    suspicious = F.coalesce(*[F.when(any_part(low, needed) & low.rlike(p), d) for p, d, needed in SUSPICIOUS])
    detailed = low.rlike("|".join(f"(?:{p})" for p in DETAILS))
    return F.array_compact(
        F.array(
            F.when(
                (letters > 5) & (upper > 0.3),
                _flag(
                    "EXCESSIVE_CAPS",
                    "high",
                    "Excessive use of capital letters",
                    F.concat(percent(upper), F.lit(" of letters are uppercase")),
                ),
            ),
            F.when(
                bangs >= 5,
                _flag(
                    "EXCESSIVE_EXCLAMATIONS",
                    "medium",
                    "Excessive use of exclamation marks",
                    F.concat(F.lit("Contains "), bangs.cast("string"), F.lit(" exclamation marks")),
                ),
            ),
            F.when(
                questions >= 3,
                _flag(
                    "EXCESSIVE_QUESTIONS",
                    "low",
                    "Excessive use of question marks",
                    F.concat(F.lit("Contains "), questions.cast("string"), F.lit(" question marks")),
                ),
            ),
            F.when(
                (n_words < 8) & low.rlike(GENERIC),
                _flag(
                    "GENERIC_LANGUAGE",
                    "low",
                    "Vague generic praise/criticism",
                    "Review contains only generic/vague phrases without detail",
                ),
            ),
            F.when(
                suspicious.isNotNull(),
                _flag("SUSPICIOUS_PHRASE", "medium", suspicious, "Contains suspicious marketing language"),
            ),
            F.when(
                (n_words >= 4) & (F.size(F.array_distinct(pairs)) * 2 < n_words - 1),
                _flag(
                    "REPETITIVE_TEXT", "high", "Repetitive or templated text", "High repetition of phrases detected"
                ),
            ),
            F.when(
                (n_words < 15) & ~detailed,
                _flag(
                    "LACKS_SPECIFICS",
                    "low",
                    "Lacks specific details",
                    "No specific measurements, prices, dates, or specifications mentioned",
                ),
            ),
        )
    )


def suspicion_score(red_flags: Column) -> Column:
    weigh = lambda f: F.when(f.getField("severity") == "high", WEIGHTS["high"]).when(
        f.getField("severity") == "medium", WEIGHTS["medium"]
    ).otherwise(WEIGHTS["low"])
    return F.least(F.lit(100), F.aggregate(red_flags, F.lit(0), lambda acc, f: acc + weigh(f)))


def suspicion_level(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def red_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``red_flags``, ``total_flags``, ``suspicion_score`` and ``suspicion_level``."""
    return (
        df.withColumn("_text", strip(F.col(text)))
        .withColumn("_low", F.lower("_text"))
        .withColumn("_words", words(F.col("_low")))
        .withColumn("red_flags", flags(F.col("_text"), F.col("_low"), F.col("_words")))
        .drop("_text", "_low", "_words")
        .withColumn("total_flags", F.size("red_flags"))
        .withColumn("suspicion_score", suspicion_score(F.col("red_flags")))
        .withColumn("suspicion_level", suspicion_level(F.col("suspicion_score")))
    )
