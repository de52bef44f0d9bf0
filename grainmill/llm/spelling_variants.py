"""Spelling variants: words one edit apart, found through bands of letter parities.

A word's mask has one bit for each letter that it holds an odd number of
times. One inserted or deleted letter flips one bit, one replaced letter two,
so of three bands of the mask at least one stays equal. Words meet when a band
is equal, their lengths differ by one at most, and half of the word, before or
after the edit, is equal too: of a pair whose longer word has ``L`` letters the
first ``L // 2`` or the last ``L // 2`` always agree. The masks of a pair must then
differ in exactly one bit (lengths differ) or two (lengths agree), and what is
left is verified by edit distance. A pair that meets under several keys is kept
under the first of them, so pairs need no second shuffle to be distinct.

Counting reads every text in Arrow batches; the join, the choice of forms and
the pursuit of roots are DataFrame operations. A word's form has ten times its
count, so a chain of forms has no more links than the largest count has digits,
and is followed by doubling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

#: Distinct words that a task counts before it hands them on.
HELD = 200_000
BANDS = 3
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 10
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def _lower(word: str) -> str:
    return word.translate(_ASCII_LOWER)


def _misspelt(text: str, runs: re.Pattern, prefix: str, one_in: int | None, least: int) -> Iterator[tuple[str, int]]:
    """The distinct words of a text with their occurrences, after the deletions that the hash decides."""
    words: Counter = Counter()
    for run, n in Counter(runs.findall(text)).items():
        words[_lower(run)] += n
    for word, n in words.items():
        if one_in:
            h = crc32(f"{prefix}:{word}".encode())
            if h % one_in == 0:
                cut = h % len(word)
                word = word[:cut] + word[cut + 1 :]
        if len(word) >= least:
            yield word, n


def _counter(one_in: int | None, least: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _misspelt(text or "", runs, "" if id_ is None else str(id_), one_in, least):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, delete_one_in: int | None = 31) -> DataFrame:
    """``word`` and ``n``: the words of all texts, A-Z lower-cased, that are long and frequent enough.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF. With ``delete_one_in``, of a
    document's words those whose hash with the document's id it divides lose
    one letter, which the hash chooses. Null texts hold no words; a null id counts as an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counter(delete_one_in, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bands(word: str) -> list[int]:
    """The mask in bands; neighbouring letters of the alphabet lie in different ones."""
    bands = [0] * BANDS
    for c in map(ord, word):
        bit = c - 0x61 if c < 0x80 else 26 + c - 0xC0
        bands[bit % BANDS] ^= 1 << bit // BANDS
    return bands


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a word as the longer (or equal) and as the shorter word of a pair."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bands = _bands(word)
            for shorter in (False, True):
                longest = len(word) + shorter
                half = longest // 2
                for side, affix in enumerate((word[:half], word[-half:])):
                    for band, value in enumerate(bands):
                        for column, value_ in zip(out, (f"{longest}.{side}{band}.{value:x}.{affix}", shorter, side, band, word, n, bands, half), strict=True):
                            column.append(value_)
        types = (pa.string(), pa.bool_(), pa.int8(), pa.int8(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32())
        names = ("key", "shorter", "side", "band", "word", "n", "bands", "half")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], list(names))


_KEYS = "key string, shorter boolean, side byte, band byte, word string, n long, bands array<int>, half int"


def _flips(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, BANDS)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each pair of different words one inserted, deleted or replaced letter apart, once.

    ``words`` has distinct words of letters U+0061 to U+007A and U+00C0 to U+00FF, at least
    two letters long, and their counts ``n``.
    """
    space = Workspace(words.sparkSession, "variants")
    keys = space.table("keys", words.select("word", "n").mapInArrow(_keys, _KEYS))
    left = keys.where("NOT shorter").select("key", "side", "band", "half", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bands").alias("a_bands"))
    right = keys.select("key", "shorter", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bands").alias("b_bands"))
    met = left.join(right, "key").where((F.col("shorter") | (F.col("a") < F.col("b"))) & (_flips("a_bands", "b_bands") == F.when(F.col("shorter"), 1).otherwise(2)))
    # the first key under which the two meet: no lower band is equal, and the first halves only if this key is of first halves
    first = (F.col("side") == 0) | (F.expr("left(a, half)") != F.expr("left(b, half)"))
    for lower in range(BANDS - 1):
        first &= (F.col("band") <= lower) | (F.get("a_bands", F.lit(lower)) != F.get("b_bands", F.lit(lower)))
    return met.where(first).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """Each word's near words, its form and the root that forms lead to.

    ``words`` holds distinct words and counts (``count_words``). Two words are near if
    one inserted, deleted or replaced letter separates them. A word's form is its
    near word of largest count (ties: the least in code-point order), where that
    count is at least ``ratio`` times the word's own. Returns ``word``, ``n``, ``n_near``,
    ``form`` and ``form_n`` (null without a form) and ``root`` (the word itself without a
    form). An empty table gives an empty result; words of null are left out.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often as its variant")
    spark = words.sparkSession
    space = Workspace(spark, "roots")
    known = space.table("words", words.where("word IS NOT NULL").select("word", "n"))
    pairs = space.table("pairs", near_pairs(known))
    both = pairs.selectExpr("a AS word", "a_n AS n", "struct(-b_n AS rank, b AS near) AS near").unionAll(pairs.selectExpr("b", "b_n", "struct(-a_n AS rank, a AS near)"))
    alone = known.select("word", "n", F.lit(None).cast("struct<rank: bigint, near: string>").alias("near"))
    best = both.unionAll(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
    has = F.expr(f"-best.rank >= {ratio} * n")
    chosen = space.table("chosen", best.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n")))
    ends = chosen.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most, links = chosen.agg(F.max("n")).first()[0] or 0, 0
    while most >= ratio:  # counts along a chain grow by the ratio: no chain has more links
        most, links = most // ratio, links + 1
    reach, step = 1, 0
    while reach < links:
        step, reach = step + 1, 2 * reach
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = space.table(f"ends{step}", ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return chosen.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
