"""Rows without listed keys, where rows are wide and keys may be many."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each key, and log2 of its 64-bit words: 2^18 broadcast rows at most.
_BITS_A_KEY = 16
_WORDS = (4, 18)


def without_keys(rows: DataFrame, keys: DataFrame, key: str, words: tuple[int, int] = _WORDS) -> DataFrame:
    """Rows whose ``key`` is not among ``keys`` (a table of that column, read three times); rows with a null key stay.

    A filter of bounded size is broadcast. Rows that it lets pass stay where they
    are; only the others, which are the listed ones and some more, are shuffled and
    joined. Keys compare as the type that they have in ``keys``. ``_h``, ``_word``
    and ``_bits`` are reserved.
    """
    listed = keys.count()
    size = 1 << min(max(math.ceil(math.log2(max(_BITS_A_KEY * listed / 64, 1))), words[0]), words[1])
    word, bit = F.expr(f"_h & {size - 1}L"), F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, 58) AS int))")
    marks = keys.select(F.xxhash64(key).alias("_h")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    tested = rows.withColumn("_h", F.xxhash64(F.col(key).cast(keys.schema[key].dataType))).join(F.broadcast(marks), word == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    # by merging at every size: neither side is bounded
    rest = tested.where(maybe).select(*rows.columns).join(keys.select(key).distinct().hint("merge"), key, "left_anti")
    return tested.where(~maybe).select(*rows.columns).unionByName(rest.select(*rows.columns))
