"""Small scalar helpers: text, safe division, closeness, digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recohort.contracts import ADDRESS_PATTERN, HASH_PATTERN, ZERO_ADDRESS


def is_address(text: Column) -> Column:
    return text.rlike(ADDRESS_PATTERN) & (F.lower(text) != ZERO_ADDRESS)


def is_hash(text: Column) -> Column:
    return text.rlike(HASH_PATTERN)


def fold(text: Column) -> Column:
    """Trimmed and case-folded, as export headers and keys are compared."""
    return F.lower(F.trim(text))


def after_last(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def before_last(text: Column, separator: str) -> Column:
    """Everything before the last separator; null when there is none."""
    tail = F.length(after_last(text, separator)) + len(separator)
    return F.when(text.contains(separator), F.left(text, F.length(text) - tail))


def rate(numerator: Column, denominator: Column) -> Column:
    """Null, never an error, for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def is_finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def is_close(left: Column, right: Column, tolerance: float) -> Column:
    """Relative or absolute closeness with the same tolerance."""
    gap = F.abs(left - right)
    return (left == right) | is_finite(left) & is_finite(right) & (gap <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(left), F.abs(right)),
                                                F.lit(tolerance)))


def git_blob_digest(content: Column) -> Column:
    """SHA-1 of ``blob <length>\\0<content>``."""
    header = F.concat(F.lit("blob ").cast("binary"),
                      F.octet_length(content).cast("string").cast("binary"),
                      F.unhex(F.lit("00")))
    return F.sha1(F.concat(header, content))
