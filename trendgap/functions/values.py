"""Column expressions over numbers and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ISO 8601 in extended form, with an optional offset at the end. Fractions
# of any length are read to the microsecond.
ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$"
)
# Basic form, and what has to be put between its parts.
BASIC_DATE = r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])"
BASIC_CLOCK = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})?(?=$|[.,Z+-])"
LONG_FRACTION = r"(:\d{2})[.,](\d{1,6})\d*"
OFFSET = r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"
MIDNIGHT = "0000-00-00T00:00:00"


def to_count(text: Column) -> Column:
    """Whole number in a text field; fractions are cut off, anything else is NULL."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def first_count(*options: Column) -> Column:
    """First option that is neither NULL nor zero, else zero."""
    return F.coalesce(*[F.nullif(to_count(o), F.lit(0)) for o in options], F.lit(0)).cast("bigint")


def estimated_shares(likes: Column, share_of_likes: float) -> Column:
    return F.greatest((likes * F.lit(share_of_likes)).cast("bigint"), F.lit(0).cast("bigint"))


def iso_to_utc(text: Column, default: Column) -> Column:
    """Clock time written in the text, taken as UTC whatever offset follows it.

    The offset is dropped, not applied; unreadable values give `default`.
    """
    text = F.regexp_replace(text, BASIC_DATE, "$1-$2-$3")
    text = F.regexp_replace(text, BASIC_CLOCK, "$1:$2:$3")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}):(?=$|[Z+-])", "$1")
    text = F.regexp_replace(text, LONG_FRACTION, "$1.$2")
    # An offset can only follow a time of day, so a plain date keeps its last part.
    clock = F.when(
        F.length(text) > 10,
        F.concat(F.substr(text, F.lit(1), F.lit(10)), F.regexp_replace(F.substr(text, F.lit(11)), OFFSET, "")),
    ).otherwise(text)
    filled = F.concat(clock, F.substr(F.lit(MIDNIGHT), F.length(clock) + 1))
    parsed = F.when(
        F.rlike(clock, F.lit(ISO_TIME)), F.concat(filled, F.lit("Z")).try_cast("timestamp")
    )
    return F.coalesce(parsed, default)


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding that two engines agree on: floor(x * 10^d + 0.5) / 10^d."""
    power = F.lit(float(10**digits))
    return F.floor(value * power + F.lit(0.5)) / power


def compact_number(count: Column) -> Column:
    """12345 -> '12.3K'; exact halves go up, values under 1000 stay as they are."""
    shown = F.when(count % 500 == 250, count + 50).otherwise(count)
    return F.when(
        count >= 1000, F.concat(F.call_function("format_number", shown / F.lit(1000.0), F.lit("0.0")), F.lit("K"))
    ).otherwise(count.cast("string"))


def score_tier(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 80, "mid").otherwise("low")
