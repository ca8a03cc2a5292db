"""Column expressions; each one stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in the order of their codes, and the limits of the score classes.
SENTIMENTS = ("negative", "neutral", "positive")
POSITIVE_FROM = 0.05
NEGATIVE_TO = -0.05


def total_engagement(*parts: str) -> Column:
    """Sum of the parts; NULL if any part is NULL."""
    return reduce(add, [F.col(p) for p in parts])


def epoch_to_timestamp(col: str | Column) -> Column:
    """Epoch seconds, also when stored as text, → timestamp."""
    return F.timestamp_seconds(_col(col).cast("bigint"))


def lenient_timestamp(col: str | Column, fmt: str | None = None) -> Column:
    """Parse text; what does not parse becomes NULL."""
    return F.try_to_timestamp(_col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(_col(col))


def slash_date(col: str | Column) -> Column:
    return F.date_format(_col(col), "yyyy/MM/dd")


def score_class(
    score: str | Column,
    positive_from: float = POSITIVE_FROM,
    negative_to: float = NEGATIVE_TO,
    labels: Sequence[str] = SENTIMENTS,
) -> Column:
    """Three-way class of a score; a missing score is neutral. ``labels`` = (low, middle, high)."""
    low, middle, high = labels
    score = _col(score)
    return F.when(score >= positive_from, high).when(score <= negative_to, low).otherwise(middle)


def class_code(col: str | Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    """Position of a class name in the alphabetical list of names, from 0; NULL for an unknown name."""
    position = F.array_position(F.array(*[F.lit(x) for x in sorted(labels)]), _col(col))
    return F.when(position > 0, (position - 1).cast("int"))


def move_class(change: str | Column, lower: str | Column, upper: str | Column) -> Column:
    """1 above ``upper``, 2 below ``lower``, else 0 (also for a missing change)."""
    change = _col(change)
    return F.when(change > _col(upper), 1).when(change < _col(lower), 2).otherwise(0)


def outside(value: str | Column, lower: str | Column, upper: str | Column) -> Column:
    value = _col(value)
    return (value > _col(upper)) | (value < _col(lower))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def list_text_to_array(col: str | Column) -> Column:
    """``"['AAPL' 'GOOG']"`` → array, without evaluating the text; an empty list gives an empty array."""
    bare = F.trim(F.regexp_replace(_col(col), r"[\[\]',\"\s]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def standardise(value: str | Column, mean: str | Column, std: str | Column) -> Column:
    """(value − mean) / std; a constant column is only centred."""
    std = _col(std)
    return (_col(value) - _col(mean)) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def unstandardise(value: str | Column, mean: str | Column, std: str | Column) -> Column:
    std = _col(std)
    return _col(value) * F.when(std == 0, F.lit(1.0)).otherwise(std) + _col(mean)


def norm(values: str | Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x * x))


def argmax(values: str | Column) -> Column:
    """0-based position of the first largest element."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
