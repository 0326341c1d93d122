"""Character-level column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve import constants as K


def text(value: str) -> Column:
    return F.lit(value)


def strip(col: Column) -> Column:
    """Drop white space (Unicode aware) on both sides."""
    return F.btrim(col, text(K.WHITESPACE))


def occurrences(col: Column, needle: str) -> Column:
    """How often a single character occurs."""
    return F.length(col) - F.length(F.replace(col, text(needle), text("")))


def occurrences_of_class(col: Column, char_class: str) -> Column:
    """How many characters belong to a regular-expression class."""
    return F.length(col) - F.length(F.regexp_replace(col, f"{char_class}+", ""))


def digits(col: Column) -> Column:
    return occurrences_of_class(col, K.DIGIT_CLASS)


def letters(col: Column) -> Column:
    return occurrences_of_class(col, K.LETTER_CLASS)


def flag(condition: Column) -> Column:
    """Boolean as 0/1; unknown counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def percent(numerator: Column, denominator: Column) -> Column:
    return F.round(ratio(numerator * 100, denominator), 6)


def characters(col: Column) -> Column:
    """Code points of a string as an array; the empty string has none."""
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(F.split(col, ""))


def entropy(col: Column) -> Column:
    """Shannon entropy of the character distribution, in bits.

    Sorting the characters turns equal ones into runs, so one regular-expression pass yields all
    counts; that beats counting each distinct character by a scan of its own.
    """
    n = F.length(col).cast("double")
    ordered = F.array_join(F.sort_array(F.split(col, "")), "")
    runs = F.regexp_extract_all(ordered, text(r"(?s)(.)\1*"), F.lit(0))

    def add(total: Column, run: Column) -> Column:
        count = F.length(run).cast("double")
        return total + count * F.log2(count)

    return F.when(F.length(col) == 0, F.lit(0.0)).otherwise(
        F.log2(n) - F.aggregate(runs, F.lit(0.0), add) / n
    )


def longest_run(col: Column, char_class: str) -> Column:
    """Length of the longest unbroken run of characters of one class."""
    runs = F.regexp_extract_all(col, text(f"{char_class}+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def case_class(col: Column) -> Column:
    """lower, upper, mixed or none, judged on ASCII letters only."""
    low, up = col.rlike("[a-z]"), col.rlike("[A-Z]")
    return (
        F.when(low & up, "mixed").when(low, "lower").when(up, "upper").otherwise("none")
    )


def encode(col: Column, length: int = K.SEQUENCE_LENGTH, stripped: bool = False) -> Column:
    """Fixed-length array of character ids, cut at ``length`` and padded on the right.

    Training keeps the text as it is; serving strips it first (``stripped=True``).
    """
    source = strip(col) if stripped else col
    kept = characters(F.substring(source, 1, length))
    # position in the sorted vocabulary string: 0 (absent) gives the unknown id, k gives k + 1
    ids = F.transform(kept, lambda ch: F.position(ch, text(K.VOCAB)) + K.UNKNOWN_ID)
    return F.concat(ids, F.array_repeat(F.lit(K.PAD_ID), F.lit(length) - F.size(kept)))
