"""Protected evidence: one pass of a multi-pattern automaton over every part of a sample.

Protected texts become patterns: runs of words (13 of a long text, all of a
short one) and runs of characters for scripts without spaces. A part is matched
against all of them at once by two Aho-Corasick automata, one over word
numbers and one over characters, whatever the patterns' widths. Patterns are dealt into
blocks of a bounded number of bytes; each block is one broadcast and one
narrow pass over the parts, so nothing of the parts is shuffled before the few hits are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.decontam import CJK_LEAST, CJK_WIDTH, LEAST_EXACT, WIDTH

#: CJK characters of a short protected text, and of a wrapped window, at least.
CJK_SHORT = 12
#: Bytes of patterns that go to every worker at once.
BLOCK_BYTES = 8 << 20
#: Kinds of match: word runs of a long and of a short text, equality with a short text, and character runs.
GRAM, RUN, EXACT, CJK_GRAM, CJK_TEXT, CJK_RUN = "gram", "run", "exact", "cjk_gram", "cjk_text", "cjk_run"

_WORD = re.compile(r"\w+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힣]")


def folded_words(text: str) -> list[str]:
    """Words of the compatibility form, case folded."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def _windows(joined: str, width: int, least: int) -> Iterator[str]:
    """Runs of ``width`` characters that hold at least ``least`` CJK characters, by a running count."""
    if len(joined) < width or not _CJK.search(joined):
        return
    marks = [1 if _CJK.match(c) else 0 for c in joined]
    inside = sum(marks[:width])
    for i in range(len(joined) - width + 1):
        if inside >= least:
            yield joined[i : i + width]
        if i + width < len(joined):
            inside += marks[i + width] - marks[i]


def _patterns_of(text: str, reserved: bool) -> Iterator[tuple[str, str]]:
    w = folded_words(text)
    joined = "".join(w)
    if len(w) >= WIDTH:
        yield from ((GRAM, " ".join(w[i : i + WIDTH])) for i in range(len(w) - WIDTH + 1))
    elif len(w) >= LEAST_EXACT:
        yield RUN if reserved else EXACT, " ".join(w)
    yield from ((CJK_GRAM, g) for g in _windows(joined, CJK_WIDTH, CJK_LEAST))
    if len(joined) < CJK_WIDTH and len(_CJK.findall(joined)) >= CJK_SHORT:
        yield CJK_TEXT, joined
    if reserved:
        yield from ((CJK_RUN, g) for g in _windows(joined, CJK_SHORT, CJK_SHORT))


def protected_patterns(protected: DataFrame, text_col: str = "text", reserved: bool = True) -> DataFrame:
    """Distinct ``kind`` and ``key`` of protected texts.

    Texts of 13 words or more give their 13-word runs, texts of 4 to 12 words themselves: any
    contiguous occurrence counts if ``reserved``, equality with the whole part otherwise. Runs of 32
    characters with 8 CJK characters count, shorter texts with 12 of them too, and if ``reserved`` any 12
    consecutive ones. Null and shorter texts give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set(_patterns_of(text, reserved)) if text else set()
                if found:
                    kinds, keys = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string())], ["kind", "key"])

    return protected.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "kind string, key string").distinct()


class Matcher:
    """Kinds of the patterns that a text contains."""

    def __init__(self, patterns: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.number: dict[str, int] = {}
        self.exact = {key for kind, key in patterns if kind == EXACT}
        self.words = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.characters = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        of_words, of_characters = {}, {}
        for kind, key in patterns:
            if kind in (GRAM, RUN):
                run = tuple(self.number.setdefault(w, len(self.number) + 1) for w in key.split(" "))
                of_words.setdefault(run, set()).add(kind)
            elif kind != EXACT:
                of_characters.setdefault(key, set()).add(kind)
        for automaton, runs in ((self.words, of_words), (self.characters, of_characters)):
            for key, kinds in runs.items():
                automaton.add_word(key, tuple(kinds))
            if runs:
                automaton.make_automaton()
        self.any_words, self.any_characters = bool(of_words), bool(of_characters)

    def kinds(self, text: str) -> set[str]:
        w = folded_words(text)
        found: set[str] = set()
        if self.any_words and len(w) >= LEAST_EXACT:
            known = self.number.get
            for _, kinds in self.words.iter(tuple([known(x, 0) for x in w])):
                found.update(kinds)
        if self.exact and LEAST_EXACT <= len(w) < WIDTH and " ".join(w) in self.exact:
            found.add(EXACT)
        if self.any_characters and _CJK.search(text):
            for _, kinds in self.characters.iter("".join(w)):
                found.update(kinds)
        return found


def _blocks(patterns: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """Patterns dealt by hash into blocks of at most ``block_bytes`` (or one pattern): each is fetched when it is sent."""
    sized = patterns.select("kind", "key", (F.octet_length("key") + 16).alias("bytes"), F.xxhash64("kind", "key").alias("h"))
    total, most = sized.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    if not most:
        return []
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    while n < most and sized.groupBy(F.pmod("h", F.lit(n))).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > block_bytes:
        n *= 2
    return [sized.where(F.pmod("h", F.lit(n)) == i).select("kind", "key") for i in range(n)]


def part_hits(parts: DataFrame, patterns: DataFrame, ids: list[str], text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``ids`` and ``kind`` of every kind of pattern that a part's text contains, each once.

    Parts are rows: a sample's states, instructions and candidates. Null and empty texts contain nothing.
    """
    spark = parts.sparkSession
    from grainmill.plans.shipping import ship
    from grainmill.plans.workspace import Workspace

    ship(spark)
    patterns = Workspace(spark, "patterns").table("patterns", patterns.select("kind", "key"))
    rows = parts.select(*ids, F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(*ids).schema.add("kind", "string")
    names = [*ids, "kind"]
    found = []
    for block in _blocks(patterns, block_bytes):
        sent = spark.sparkContext.broadcast([(r["kind"], r["key"]) for r in block.collect()])  # block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                at, kinds = [], []
                for i, text in enumerate(batch.column(len(ids)).to_pylist()):
                    for kind in matcher.kinds(text) if text else ():
                        at.append(i)
                        kinds.append(kind)
                if at:
                    picked = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(picked) for j in range(len(ids))), pa.array(kinds, pa.string())], names)

        found.append(rows.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found).distinct()


def blocked_samples(parts: DataFrame, hits: DataFrame, sample: str) -> DataFrame:
    """One row per sample: ``n_parts``, ``kinds`` (sorted) that any part hit and ``blocked``; one hit part blocks the whole sample."""
    of = hits.groupBy(F.col(sample).alias("_of")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    counted = parts.groupBy(sample).agg(F.count(F.lit(1)).alias("n_parts"))
    return counted.join(of, F.col(sample).eqNullSafe(F.col("_of")), "left").select(sample, "n_parts", F.coalesce("kinds", F.lit("")).alias("kinds"), F.col("kinds").isNotNull().alias("blocked"))
