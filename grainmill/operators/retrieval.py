"""Lexical retrieval over the spans of long documents (BM25)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from grainmill.functions import text as T

K1, B = 1.2, 0.75


def bm25(spans: DataFrame, queries: DataFrame, doc: str = "doc_id", span: str = "span", text: str = "text") -> DataFrame:
    """Scores of a document's spans against its own query (``doc``, ``query``): statistics are those of the one document.

    One shuffle by document serves term counts, document frequencies and lengths.
    """
    tokens = spans.select(doc, span, T.query_tokens(text).alias("w"))
    sizes = tokens.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    asked = queries.select(doc, F.explode(F.array_distinct(T.query_tokens("query"))).alias("term"))
    tf = tokens.select(doc, span, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy(doc, span, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(asked, [doc, "term"])
    df = tf.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, [doc, "term"]).join(sizes, doc)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1.0))))
    found = scored.groupBy(doc, span).agg(F.sum(part).alias("score"))
    return spans.select(doc, span).join(found, [doc, span], "left").select(doc, span, F.coalesce("score", F.lit(0.0)).alias("score"))


def _tokens(text: str | None) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower().replace("ß", "ss")) if len(w) > 1 and w not in T.STOP_WORDS]


def _score(texts: Sequence[str | None], asked: str | None) -> list[float]:
    """Scores of one document's spans; sums are exact, so that spans with equal words score alike in any order of them."""
    counts, df, terms = [Counter(_tokens(t)) for t in texts], Counter(), set(_tokens(asked))
    lengths = [sum(c.values()) for c in counts]
    for c in counts:
        df.update(c.keys() & terms)
    n, mean = len(counts), max(sum(lengths) / max(len(lengths), 1), 1.0)
    idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (K1 + 1) for t in df}
    out = []
    for c, length in zip(counts, lengths, strict=True):
        norm = K1 * (1 - B + B * length / mean)
        out.append(math.fsum(idf[t] * c[t] / (c[t] + norm) for t in c.keys() & idf.keys()))
    return out


@F.pandas_udf(ST.ArrayType(ST.DoubleType()))
def _row_scores(texts: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _score(t, q) for t, q in zip(texts, asked, strict=True)], dtype=object)


def bm25_in_row(spans: Column, query: Column) -> Column:
    """The same scores where a document's spans (array of text) are in its own row: nothing is shuffled.

    Null spans or a null query score as empty ones; a null array gives null.
    """
    return _row_scores(spans, query)


@F.pandas_udf(ST.ArrayType(ST.StructType().add("start", ST.IntegerType()).add("stop", ST.IntegerType()).add("score", ST.DoubleType())))
def _scored_spans(text: pd.Series, asked: pd.Series) -> pd.Series:
    out = []
    for t, q in zip(text, asked, strict=True):
        spans = T.span_bounds(t)
        out.append([{"start": a, "stop": b, "score": x} for (a, b), x in zip(spans, _score([t[a:b] for a, b in spans], q), strict=True)])
    return pd.Series(out, dtype=object)


def scored_evidence_spans(text: Column, query: Column) -> Column:
    """Evidence spans of a text with their BM25 scores, in its own row; a null text has none."""
    return _scored_spans(text, query)


def pack_spans(ranked: DataFrame, budget: int, doc: str = "doc_id") -> DataFrame:
    """Spans (``doc``, ``priority``, ``span``, ``chars``) taken by priority while they fit the budget; one too long is passed over and the walk goes on."""
    per_doc = ranked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("priority", "span", "chars"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, s: F.when(~F.array_contains(a["taken"], s["span"]) & (a["used"] + s["chars"] <= budget), F.struct((a["used"] + s["chars"]).cast("long").alias("used"), F.concat(a["taken"], F.array(s["span"])).alias("taken"))).otherwise(a)
    return per_doc.select(doc, F.aggregate("s", start, step).alias("r")).select(doc, F.col("r.used").alias("chars"), F.array_sort("r.taken").alias("spans"))


#: Characters of a selection at most, of a source that is left whole, and of the end that is always tried.
SELECT_CHARS, WHOLE_CHARS, TAIL_CHARS = 5800, 5000, 1100
#: Best spans taken, and best spans whose neighbours are taken as well.
TOP, TOP_NEIGHBOURS = 12, 5


def select_spans(spans: DataFrame, scores: DataFrame, doc: str = "doc_id", budget: int = SELECT_CHARS) -> DataFrame:
    """Spans of each long document that fit the budget: the first, those of its end, the best ones, neighbours of the very best.

    ``spans``: (``doc``, ``span``, ``start``, ``stop``, ``length``), the last being that of the whole source;
    ``scores``: (``doc``, ``span``, ``score``). Equal scores rank by place. Sources of at most ``WHOLE_CHARS``
    characters have no selection. Returns ``doc``, ``chars`` and ``spans`` in their order in the source.
    """
    return select_scored(spans.join(scores, [doc, "span"]), doc, budget)


def select_scored(rows: DataFrame, doc: str = "doc_id", budget: int = SELECT_CHARS) -> DataFrame:
    """The same selection of spans that carry their ``score``: one shuffle by document, without its text."""
    rows = rows.where(F.col("length") > WHOLE_CHARS)
    by_score = Window.partitionBy(doc).orderBy(F.desc("score"), "span")
    by_place = Window.partitionBy(doc).orderBy("span")
    rows = rows.withColumn("rank", F.row_number().over(by_score))
    rows = rows.withColumns({"before": F.lead("rank").over(by_place), "after": F.lag("rank").over(by_place)})

    def turn(step: int, wanted, place, side: int = 0):
        return F.when(wanted, F.struct(F.lit(step).alias("step"), place.cast("int").alias("place"), F.lit(side).alias("side")))

    turns = F.array_compact(
        F.array(
            turn(0, F.col("span") == 0, F.lit(0)),
            turn(1, F.col("start") >= F.greatest(F.col("length") - TAIL_CHARS, F.lit(0)), F.col("span")),
            turn(2, F.col("rank") <= TOP, F.col("rank")),
            turn(3, F.col("before") <= TOP_NEIGHBOURS, F.col("before"), 0),
            turn(3, F.col("after") <= TOP_NEIGHBOURS, F.col("after"), 1),
        )
    )
    chosen = rows.select(doc, "span", (F.col("stop") - F.col("start")).cast("long").alias("chars"), F.explode(turns).alias("priority"))
    return pack_spans(chosen, budget, doc)
