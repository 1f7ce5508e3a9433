"""Person-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grantlens.functions.text import blank_to_null, squeeze, words

# Honorifics and relation prefixes dropped from the front of a name.
HONORIFICS = (
    "thirumathi|thirumati|thiru|tirumati|tmt|selvan|selvi|kumari|km|mrs|miss|mr|ms|prof|dr|"
    "srimati|shri|sri|smt|kum|m/s|messrs|s/o|d/o|w/o|h/o|g/o"
)
# A prefix ends at a dot or at a word edge; several may follow each other.
LEADING_HONORIFICS = rf"(?i)^(?:(?:{HONORIFICS})(?:\.|(?![A-Za-z0-9_]))\s*)+"


def strip_honorifics(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), LEADING_HONORIFICS, ""))


def normalize_name(name: Column) -> Column:
    """Honorifics and stray symbols removed, single spaces; NULL stays NULL."""
    out = F.regexp_replace(strip_honorifics(name), r"^[:\-–—.]\s*", "")
    return squeeze(F.regexp_replace(out, r"[^a-zA-Z0-9\s.'\-]", " "))


def name_tokens(name: Column) -> Column:
    """Lower-case tokens without surrounding punctuation, empty array for NULL."""
    tokens = F.transform(
        F.split(F.lower(normalize_name(name)), r"\s+"),
        lambda t: F.regexp_replace(t, r"""^[.,\-_/\\#;:'"]+|[.,\-_/\\#;:'"]+$""", ""),
    )
    return F.coalesce(F.filter(tokens, lambda t: t != ""), F.array().cast("array<string>"))


def token_sort(name: Column) -> Column:
    return F.array_join(F.array_sort(words(F.lower(normalize_name(name)))), " ")


def title_name(name: Column) -> Column:
    """Title case that keeps single-letter initials upper-case."""

    def one(part: Column) -> Column:
        letters = F.regexp_replace(part, "[^A-Za-z]", "")
        return (
            F.when(letters == "", part)
            .when(F.length(letters) == 1, F.upper(letters))
            .otherwise(F.concat(F.upper(F.substring(letters, 1, 1)), F.lower(F.substr(letters, F.lit(2)))))
        )

    return F.array_join(F.transform(words(normalize_name(name)), one), " ")


def letters_key(name: Column) -> Column:
    """Upper-case letters and single spaces, the form used for similarity ratios."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z\s]", ""), r"\s+", " ")


def similarity(a: Column, b: Column) -> Column:
    """(longer − edit distance) / longer; 0 when either side is missing or empty."""
    longer = F.greatest(F.length(a), F.length(b))
    usable = (a != "") & (b != "")
    return F.when(F.coalesce(usable, F.lit(False)), (longer - F.levenshtein(a, b)) / longer).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return similarity(letters_key(a), letters_key(b))


def real_name(name: Column) -> Column:
    """NULL for blanks and for the literal text null."""
    trimmed = blank_to_null(F.trim(name))
    return F.when(trimmed != "null", trimmed)
