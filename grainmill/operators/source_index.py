"""An index of a text: spans that tile it, and the dates and numbers in them by id.

A text is cut at line ends and sentence ends, long stretches at spaces. Spans
that are not blank are numbered, and so are the dates and then the numbers of each,
in one count over the text; digits inside a date are no numbers. Only the cut
is Python; values are found by column functions, and the place of a value in the row's
list is its number, so nothing is sorted or shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# Fixed values, part of the data contract: patterns of dates and numbers, where spans end, and their greatest and least length.
DATE = r"\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?\b"
NUMBER = r"(?<![\w.])-?\d+(?:,\d{3})*(?:\.\d+)?(?!\w|\.\d)"
BOUNDARY = r"\n+|(?<=[.!?])\s+(?=[A-Z])"
MOST, LEAST = 420, 80


def _java(pattern: str) -> str:
    """The same pattern for Spark: word characters are letters, digits and other numerals of any script, and a border of a date is none beside it."""
    word = r"\p{L}\p{N}_"
    out = pattern.replace(r"[\w.]", f"[{word}.]").replace(r"(?!\w|", f"(?![{word}]|").replace(r"\d", r"\p{Nd}")
    return (f"(?<![{word}])" + out[2:-2] + f"(?![{word}])") if out.startswith(r"\b") else out


#: The three forms of a date by length, longest first: each gives way to as many spaces.
_FORMS = {19: r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b", 16: r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}\b", 10: r"\b\d{4}-\d{2}-\d{2}\b"}
_SPANS = ST.ArrayType(ST.StructType([ST.StructField("start", ST.LongType()), ST.StructField("stop", ST.LongType()), ST.StructField("span", ST.LongType()), ST.StructField("text", ST.StringType())]))


def spans(text: str | Column, most: int = MOST) -> Column:
    """Array of ``start``, ``stop``, ``span`` (its number, null if blank) and ``text``: pieces that joined give back the text."""
    if most < LEAST:
        raise ValueError(f"spans are at least {LEAST} long")
    ends = re.compile(BOUNDARY)

    def one(t: str | None) -> list[tuple]:
        out, number, at = [], 0, 0
        t = t or ""
        for stop in [*(m.end() for m in ends.finditer(t)), len(t)]:
            while at < stop:
                end = min(stop, at + most)
                gap = t.rfind(" ", at + most // 2, end) if end < stop else -1
                end = gap + 1 if gap >= 0 else end
                filled = not t[at:end].isspace()
                out.append((at, end, number if filled else None, t[at:end]))
                number, at = number + filled, end
        return out

    @F.pandas_udf(_SPANS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return cut(text)


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(DATE)), F.lit(0))


def numbers(text: Column) -> Column:
    """Numbers outside dates, without their separators of thousands."""
    for length, form in _FORMS.items():
        text = F.regexp_replace(text, _java(form), " " * length)
    return F.transform(F.regexp_extract_all(text, F.lit(_java(NUMBER)), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def source_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``id``, ``place`` and the fields of ``spans``, one row per piece; null and empty texts have none."""
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(spans(F.col(text_col).cast("string"), most)).alias("place", "s"))
    return cut.select("id", "place", "s.span", "s.start", "s.stop", "s.text")


def source_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``id``, ``name`` (d or n and a number that runs over the text), ``span``, ``kind`` and ``value`` of every date and number."""
    cut = docs.select(F.col(id_col).alias("id"), spans(F.col(text_col).cast("string"), most).alias("s"))
    tag = lambda kind, values, s: F.transform(values, lambda v: F.struct(s["span"].alias("span"), F.lit(kind).alias("kind"), v.alias("value")))
    found = F.flatten(F.transform(F.filter("s", lambda s: s["span"].isNotNull()), lambda s: F.concat(tag("date", dates(s["text"]), s), tag("number", numbers(s["text"]), s))))
    rows = cut.select("id", F.posexplode(found).alias("n", "f"))
    return rows.select("id", F.concat(F.substring("f.kind", 1, 1), F.col("n").cast("string")).alias("name"), "f.span", "f.kind", "f.value")
