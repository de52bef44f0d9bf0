"""Substring deduplication over sliding sentence spans.

A text is cut into sentences at line ends and after closing punctuation. From
every sentence on, and up to every sentence, the run of consecutive sentences
that is just long enough (at least ``min_sentences`` of them and ``min_words``
words) is hashed, and on demand every long sentence by itself and every text as a
whole; runs with the same words are joined
over all documents; and the sentences of every occurrence but the first, by
document id and place, are removed.

Runs with one occurrence are dropped by a partial aggregation before the join,
and the texts themselves are never shuffled by content: removals travel to
the documents as sentence numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._bytes import SPACED, Words, chunks, mix
from grainmill.plans.workspace import Workspace

_U = np.uint64
_PRIME = _U(0x9FB21C651E98DF25)
_STOPS = np.frombuffer(b".!?", np.uint8)
_QUOTES = np.frombuffer(b"\"')]", np.uint8)


def sentence_starts(words: Words) -> np.ndarray:
    """Index of the first word of every sentence of a chunk.

    A sentence begins a document, follows a line end, or follows a word that ends
    in ``.``, ``!`` or ``?`` (perhaps with closing quotes or brackets after it).
    """
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.zeros(n + 1, bool)
    starts[words.first] = True
    lines = np.flatnonzero(words.raw == 10)
    starts[np.searchsorted(words.start, lines)] = True
    at = words.stop - 1
    for _ in range(2):
        at = np.where(np.isin(words.raw[at], _QUOTES) & (at > words.start), at - 1, at)
    starts[1:][np.isin(words.raw[at], _STOPS)] = True
    return np.flatnonzero(starts[:n])


def _spans(words: Words, starts: np.ndarray, min_sentences: int, min_words: int, alone: int | None = None, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last sentence (chunk-wide numbers) of the least long-enough run from, and up to, every sentence.

    Also of sentences of ``alone`` words or more, and, if ``whole``, of whole texts.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(words.hash))
    every = np.arange(n)
    ahead = np.maximum(every + min_sentences - 1, np.searchsorted(ends, starts + min_words))
    back = np.minimum(every - min_sentences + 1, np.searchsorted(starts, ends - min_words, "right") - 1)
    doc = np.searchsorted(words.first, starts, "right") - 1
    long_ = every[ends - starts >= alone] if alone is not None else every[:0]
    heads = every[np.diff(doc, prepend=-1) > 0] if whole else every[:0]
    tails = np.append(heads[1:], n)[: len(heads)] - 1
    runs = np.unique(np.concatenate([every << 32 | ahead, back[back >= 0] << 32 | every[back >= 0], long_ << 32 | long_, heads << 32 | tails]))
    first, last = runs >> 32, runs & 0xFFFFFFFF
    inside = (last < n) & (doc[first] == doc[np.minimum(last, n - 1)])
    first, last = first[inside], last[inside]
    # polynomial sums over the words: any run's hash from two of them
    power = np.full(len(words.hash) + 1, _PRIME, _U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(words.hash) + 1, _U)
    inverse = np.full(len(words.hash) + 1, _U(pow(int(_PRIME), -1, 1 << 64)), _U)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    np.cumsum(words.hash * power[:-1], out=sums[1:])
    a, b = starts[first], ends[last]
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93)), first, last


def _emit_spans(min_sentences: int, min_words: int, alone: int | None, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in chunks(batch.column(1), SPACED):
                starts = sentence_starts(words)
                span, first, last = _spans(words, starts, min_sentences, min_words, alone, whole)
                if not len(span):
                    continue
                doc = np.searchsorted(words.first, starts[first], "right") - 1
                base = np.searchsorted(starts, words.first[doc])
                yield pa.RecordBatch.from_arrays([pa.array(span.view(np.int64)), *(batch.column(c).take(pa.array(low + doc)) for c in (0, 2)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["span", "id", "body", "first", "last"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, sentences = batch.column(1).to_pylist(), [], []
        gone = batch.column(2).to_pylist()
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for low, words in chunks(batch.column(1), SPACED):
            starts = sentence_starts(words)
            doc_first = np.searchsorted(starts, words.first)
            for d in range(words.docs):
                own = starts[doc_first[d] : doc_first[d + 1]]
                sentences.append(len(own))
                drop = gone[low + d]
                if not drop or not len(own):
                    removed.append([])
                    continue
                cut = np.zeros(len(own) + 1, np.int64)
                for a, b in drop:
                    cut[a] += 1
                    cut[b + 1] -= 1
                cut = np.cumsum(cut)[:-1] > 0
                # byte ranges: a sentence runs from its first word to the next sentence's
                edges = np.append(words.start[own], -1)
                data = texts[low + d].encode()
                base = edges[0] - _lead(data)
                edges[:-1] -= base
                edges[-1] = len(data)
                parts, spans = [data[: edges[0]]], []
                for i in range(len(own)):
                    if cut[i]:
                        if spans and spans[-1]["stop"] == edges[i]:
                            spans[-1]["stop"] = int(edges[i + 1])
                        else:
                            spans.append({"start": int(edges[i]), "stop": int(edges[i + 1])})
                    else:
                        parts.append(data[edges[i] : edges[i + 1]])
                texts[low + d] = b"".join(parts).decode()
                removed.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sentences, pa.int32()), pa.array(removed, spans_type)], ["id", "text", "n_sentences", "removed"])


def _lead(data: bytes) -> int:
    return len(data) - len(data.lstrip(b"\t\n\x0b\x0c\r "))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20, alone: int | None = None, whole: bool = False) -> DataFrame:
    """Remove sentences inside any repeated run of sentences, but at its first occurrence.

    Words compare with A-Z lower-cased and white space ignored. The first
    occurrence is the one with the least id, then the earliest in the text; a run
    that repeats inside one document loses its later occurrences as well. A run
    is removed even if it overlaps the first occurrence of another run. A run has
    at least ``min_sentences`` sentences and ``min_words`` words; with ``alone``, a
    single sentence of so many words is one too, and with ``whole`` so is every
    text as a whole, however short.

    Returns one row per input row: ``id``, ``text`` (what is left, byte for byte),
    ``n_sentences`` and ``removed`` (byte ranges of the original text). Null
    texts stay null and empty ones empty, with no sentences. With
    ``whole``, a text that repeats an earlier one wholly is left empty. Rows that repeat an id are told apart by
    their texts; equal rows of one id are one document and keep the same
    sentences. Ids are integers; rows without one come before all others. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "spans")
    text = F.col(text_col).cast("string")
    # rows that share an id are told apart by a hash of their texts
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("body"))
    spans = rows.mapInArrow(_emit_spans(min_sentences, min_words, alone, whole), "span long, id long, body long, first int, last int")
    known = spans.select("span", F.struct("id", "body", F.expr("shiftleft(cast(first AS bigint), 32) | last").alias("place")).alias("at"))
    # summed before the shuffle; the join that follows lets Spark split a span that very many documents share
    heads = known.groupBy("span").agg(F.min("at").alias("head"), F.max("at").alias("tail")).where("head <> tail").select("span", "head")
    repeats = known.join(heads, "span").where("at <> head").select("at.id", "at.body", "at.place")
    repeats = space.table("repeats", repeats.distinct())
    drops = repeats.groupBy("id", "body").agg(F.collect_list("place").alias("places"))
    drops = drops.select(F.col("id").alias("of"), F.col("body").alias("of_body"), F.expr("transform(places, p -> array(cast(shiftright(p, 32) AS int), cast(p & 4294967295 AS int)))").alias("gone"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")), "left").select("id", "text", "gone")
    return joined.mapInArrow(_cut, "id long, text string, n_sentences int, removed array<struct<start: int, stop: int>>")
