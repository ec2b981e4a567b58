"""Words and word shingles as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words: everything but letters and digits.
GAP = r"[^\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits; NULL text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def shingle_array(words: Column, size: int, join: Callable[..., Column]) -> Column:
    """Shingles of ``size`` words, each made by ``join(*words)``; of a shorter, non-empty list the whole as one, by
    ``join`` of an array. ``words`` is evaluated once."""

    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: join(*[F.get(w, i + k) for k in range(size)])
        )
        short = F.when(F.size(w) > 0, F.array(join(w))).otherwise(F.array().cast(f"array<{'string' if join is text_of else 'bigint'}>"))
        return F.when(F.size(w) >= size, runs).otherwise(short)

    return F.transform(F.array(words), of)[0]


def text_of(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def hash_of(*parts: Column) -> Column:
    return F.xxhash64(*parts) if len(parts) > 1 else F.xxhash64(F.concat_ws(" ", *parts))
