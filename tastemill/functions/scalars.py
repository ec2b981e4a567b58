"""Small scalar helpers, all plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import as_column


def sigmoid(value) -> Column:
    return 1.0 / (1.0 + F.exp(-as_column(value)))


def clip(value, low: float, high: float) -> Column:
    bounded = as_column(value)
    # least and greatest skip NULLs, so a missing value would become a bound
    return F.when(bounded.isNotNull(), F.least(F.greatest(bounded, F.lit(low)), F.lit(high)))


def normalize_text(value) -> Column:
    """Runs of line breaks become one space; a missing text becomes 'unknown'."""
    return F.coalesce(F.regexp_replace(as_column(value), r"[\r\n]+", " "), F.lit("unknown"))


def unindent(value) -> Column:
    """Join the lines of a text with one space after dropping their indentation."""
    lines = F.split(F.regexp_replace(as_column(value), r"\n$", ""), "\n")
    return F.array_join(F.transform(lines, lambda line: F.regexp_replace(line, r"^\s+", "")), " ")


def parse_bounded_number(value, low: float = 1.0, high: float = 100.0) -> Column:
    """'unknown' -> low, a range 'a-b' -> a, then clip to [low, high]; text that is no number gives NULL."""
    text = as_column(value).cast("string")
    number = F.split(text, "-")[0].try_cast("double")
    return F.when(text == "unknown", F.lit(float(low))).otherwise(clip(number, float(low), float(high)))


def reaction(value) -> Column:
    """Played share to a label: above 0.8 good, below 0.2 bad, else neutral."""
    share = as_column(value)
    return F.when(share > 0.8, "good").when(share < 0.2, "bad").otherwise("neutral")


def pad_array(value, size: int, fill) -> Column:
    """First ``size`` elements, filled up with ``fill``; a NULL array gives only fill."""
    array = F.coalesce(as_column(value), F.array().cast("array<bigint>"))
    return F.slice(F.concat(array, F.array_repeat(F.lit(fill).cast("long"), size)), 1, size)


def mask_array(value, blanks: list, fill) -> Column:
    """Replace elements equal to any of the ``blanks`` columns by ``fill``."""
    hidden = F.array(*[as_column(b) for b in blanks])
    return F.transform(as_column(value), lambda x: F.when(F.array_contains(hidden, x), F.lit(fill).cast("long")).otherwise(x))


def first_element(value, default=None) -> Column:
    return F.coalesce(F.get(as_column(value), F.lit(0)), F.lit(default))


def event_time(value) -> Column:
    """Epoch milliseconds to a timestamp."""
    return F.timestamp_millis(as_column(value))


def weighted_draw_key(draw: Column, weight: Column) -> Column:
    """Key of a weighted draw without replacement: the smallest ``-ln(u)/w`` is drawn first."""
    return -F.log(F.greatest(draw, F.lit(1e-18))) / F.greatest(weight, F.lit(1e-12))


def from_json_field(value, field: str, dtype: str) -> Column:
    return F.get_json_object(as_column(value), f"$.{field}").cast(dtype)


def to_json_record(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
