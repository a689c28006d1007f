"""Text clean-up, tokens, ratings and dates inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that separates words, beyond the ASCII ones of ``\s``.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
#: A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"

# Words left out of repeated-phrase search.
PHRASE_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "and", "but", "or", "so", "if", "it", "its", "this", "that", "i", "my",
    "me",
)

# Default English function words for term weighting; pass your own list to use another one.
TERM_STOP_WORDS = (
    "about", "above", "after", "again", "against", "all", "almost", "also", "although", "always", "am", "among", "an",
    "and", "another", "any", "anyone", "are", "around", "as", "at", "back", "be", "became", "because", "become",
    "been", "before", "being", "below", "between", "both", "but", "by", "call", "can", "cannot", "could", "do",
    "done", "down", "during", "each", "either", "else", "enough", "etc", "even", "ever", "every", "everyone",
    "everything", "few", "first", "for", "from", "further", "get", "give", "go", "had", "has", "have", "he", "hence",
    "her", "here", "hers", "him", "his", "how", "however", "if", "in", "indeed", "into", "is", "it", "its", "itself",
    "last", "least", "less", "made", "many", "may", "me", "might", "more", "most", "much", "must", "my", "myself",
    "neither", "never", "next", "no", "nobody", "none", "nor", "not", "nothing", "now", "of", "off", "often", "on",
    "once", "one", "only", "onto", "or", "other", "others", "our", "ours", "out", "over", "own", "per", "perhaps",
    "please", "put", "rather", "re", "same", "see", "seem", "she", "should", "since", "so", "some", "someone",
    "something", "still", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "those", "through", "to", "together", "too", "under", "until", "up", "upon", "us", "very", "was", "we", "well",
    "were", "what", "when", "where", "which", "while", "who", "whole", "whom", "whose", "why", "will", "with",
    "within", "without", "would", "yet", "you", "your", "yours",
)

# Accepted review date shapes, tried in this order, day before month where both fit.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)
#: Shapes tried after those, without commas, weekday and ordinal endings; month before day where both fit.
LENIENT_SHAPES = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]+ \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"

# How dates are written inside review cards.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*"
RELATIVE_DATE = r"(?i)(\d+\s+(?:months?|days?|years?|weeks?|hours?|minutes?)\s+ago)"
ABSOLUTE_DATE = rf"(?i)({MONTH}\s+\d{{1,2}},?\s+\d{{4}}|{MONTH},?\s+\d{{4}}|\d{{1,2}}\s+{MONTH},?\s+\d{{4}})"
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
ON_DATE = r"(?i)on\s+(.+)$"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(NOT_SPACE), F.lit(True))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def count_chars(text: Column, members: str) -> Column:
    """Characters of the text inside a regular-expression class; what lies between them is cut out in runs."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def clean_text(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.trim(F.regexp_replace(flat, rf"(?i)(?<!{WORD})(?:read more|read less)(?!{WORD})", ""))


def parse_rating(text: Column) -> Column:
    """First number of the text where it lies in 0..5, else null."""
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(number.between(0.0, 5.0), number)


def fingerprint(text: Column, prefix: int | None = None) -> Column:
    """Digest of the text's lower-case ASCII letters and digits: the key by which reviews count as the same.

    The whole text counts; with ``prefix``, only that many of these characters do.
    """
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.sha2(kept if prefix is None else F.substring(kept, 1, prefix), 256)


def parse_review_date(text: Column) -> Column:
    """Date out of any accepted shape. The shape is tested first, so that a parser runs only where it can succeed."""
    d = strip(text)
    tries = [F.when(d.rlike(shape), F.try_to_timestamp(d, F.lit(fmt)).cast("date")) for shape, fmt in DATE_SHAPES]
    tries.append(F.when(d.rlike(ISO_INSTANT), F.substring(d, 1, 10).try_cast("date")))
    bare = F.regexp_replace(d, r"(?i)^(?:mon|tues?|wed|wednes|thu|thurs?|fri|sat|satur|sun)(?:day)?,?\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), r"(?i)\bsept\b", "Sep")
    bare = F.regexp_replace(F.regexp_replace(bare, ",", " "), r"\s+", " ")
    tries += [F.when(bare.rlike(shape), F.try_to_timestamp(bare, F.lit(fmt)).cast("date")) for shape, fmt in LENIENT_SHAPES]
    return F.coalesce(*tries)


def find_date_text(text: Column) -> Column:
    """The part of a card line that names its date: relative, absolute, ISO, or what follows ``on``."""
    return F.coalesce(
        *[
            F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
            for pattern in (RELATIVE_DATE, ABSOLUTE_DATE, ISO_DATE, ON_DATE)
        ]
    )


def resolve_relative_date(text: Column, as_of: Column) -> Column:
    """Date of ``N units ago`` counted back from ``as_of``; null where the text has another shape."""
    n = F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s+\w+\s+ago", 1), F.lit("")).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)\d+\s+(minute|hour|day|week|month|year)", 1))
    return (
        F.when(unit.isin("minute", "hour"), F.to_date(as_of))
        .when(unit == "day", F.date_sub(as_of, n))
        .when(unit == "week", F.date_sub(as_of, n * 7))
        .when(unit == "month", F.add_months(as_of, -n))
        .when(unit == "year", F.add_months(as_of, n * -12))
    )


def epoch_or_iso_date(value: Column) -> Column:
    """Epoch milliseconds of at least 13 digits, or an ISO instant, as ``yyyy-MM-dd``; other text is kept."""
    millis = F.when(value.rlike(r"^\d{13,}$"), value.try_cast("long"))
    return (
        F.when(millis.isNotNull(), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd"))
        .when(value.contains("T"), F.split_part(value, F.lit("T"), F.lit(1)))
        .otherwise(value)
    )


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def search_any(query: str, *columns: str) -> Column:
    """True where the query is a literal, case-blind part of any of the columns; an empty query keeps every row."""
    if not query:
        return F.lit(True)
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    return hit


def words_of(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def kept_terms(words: Column, stop_words: list[str] | None = None) -> Column:
    """Of the words of a text those of two or more characters, without stop words."""
    stop = TERM_STOP_WORDS if stop_words is None else stop_words
    long = F.filter(words, lambda t: F.length(t) >= 2)
    return F.filter(long, lambda t: ~t.isin(*stop)) if stop else long


def term_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case runs of two or more word characters, without stop words."""
    stop = TERM_STOP_WORDS if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def kept_phrase_words(words: Column) -> Column:
    """Of the words of a text those of a-z, longer than two letters, without the phrase stop words."""
    return F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*PHRASE_STOP_WORDS))


def phrase_words(text: Column) -> Column:
    """Whole words of a-z, longer than two letters, without the phrase stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{WORD})[a-z]{{3,}}(?!{WORD})"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*PHRASE_STOP_WORDS))


def run_lengths(sorted_tokens: Column) -> Column:
    """Sorted tokens as ``array<struct<term, tf>>``, in one pass over the array of one row."""
    n = F.size(sorted_tokens)
    starts = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)),
    )
    return F.zip_with(
        starts,
        F.slice(starts, 2, F.greatest(n, F.lit(1))),
        lambda p, following: F.struct(
            F.get(sorted_tokens, p).alias("term"), (F.coalesce(following, n) - p).alias("tf")
        ),
    )
